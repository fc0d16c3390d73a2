"""Receiver types, one test row for each form in which a text may tell them."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import typing

FORMS = [
    ("x", "def f(x: Node): pass", "Node"),
    ("x", "fn f(x: &mut Node) {}", "Node"),
    ("x", "fn f<'a>(x: &'a dyn lib::Graph) {}", "Graph"),
    ("x", "fn f(x: Box<dyn Shape>) {}", "Shape"),
    ("x", "def f(x: Optional[models.User] = None): ...", "User"),
    ("x", "let x: readonly Cache = get()", "Cache"),
    ("x", "let mut x = Node::new(1);", "Node"),
    ("x", "let x = Point { a: 1 };", "Point"),
    ("x", "const x = await Client.connect(url)", "Client"),
    ("x", "const x = new Map<string, number>()", "Map"),
    ("x", "x := &http.Server{Addr: a}", "Server"),
    ("x", "x = pkg.sub.Thing()", "Thing"),
    ("x", "List<String> x = make();", "List"),
    ("x", "void f(const std::Vector<int>& x, int y)", "Vector"),
    ("x", "Foo *x;", "Foo"),
    ("x", "y = Node()\nx = helper(1)\nif x == Node(2): pass", None),
    ("x", "xs: Node, ax = Leaf()", None),
    ("x", "x = Node() ; x = Leaf()", "Node"),
    ("x", "x = node.Make()", "Make"),
    ("Node.make(2)", "", "Node"),
    ("new Leaf(1)", "", "Leaf"),
    (" Graph()", None, "Graph"),
    ("helper()", "", None),
    ("a.b", "a.b: Node", None),
    ("obj", "", "Thing"),
    (None, "x: Node", None),
]


@pytest.mark.parametrize("rows", [FORMS])
def test_every_form(spark, rows):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, receiver string, text string, want string")
    got = d.select("i", "receiver", "text", "want", typing.receiver_type(F.col("receiver"), F.col("text"), {"obj": "Thing"}).alias("type")).collect()
    assert [(r.receiver, r.text, r.type) for r in got] == [(r.receiver, r.text, r.want) for r in got]
