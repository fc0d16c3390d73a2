"""Kinds and weight tables of the property graph."""

from __future__ import annotations

# Node kinds, edge kinds and the six kind -> weight tables.
NODE_KINDS = ["file", "module", "class", "function", "method", "trait", "impl", "variable", "type", "document", "section", "concept", "diagram", "image", "commit", "author", "hyperedge", "flow", "package"]
EDGE_KINDS = ["defines", "calls", "imports", "inherits", "implements", "data_flow", "reads_writes", "tested_by", "member_of", "entry_of", "depends_on", "mentions", "describes", "similar_to", "rationale_for", "illustrates", "documented_by"]
TRANSITION = {"calls": 1.0, "defines": 0.7, "imports": 0.55, "depends_on": 0.55, "inherits": 1.15, "implements": 1.15, "data_flow": 0.8, "reads_writes": 0.9, "tested_by": 0.3, "member_of": 0.05, "entry_of": 0.05, "describes": 0.75, "documented_by": 0.75, "mentions": 0.75, "illustrates": 0.6, "similar_to": 0.6, "rationale_for": 0.6}
PATH_COST = {"calls": 1.0, "defines": 0.35, "imports": 1.35, "depends_on": 1.35, "inherits": 0.8, "implements": 0.8, "data_flow": 0.5, "reads_writes": 0.9, "tested_by": 1.8, "member_of": 3.0, "entry_of": 3.0, "describes": 1.1, "documented_by": 1.1, "mentions": 1.7, "illustrates": 1.7, "similar_to": 2.0, "rationale_for": 2.0}
REVERSE_IMPACT = {"calls": 1.0, "defines": 1.25, "imports": 1.6, "depends_on": 1.6, "inherits": 0.75, "implements": 0.75, "data_flow": 0.8, "reads_writes": 0.9, "tested_by": 1.1, "member_of": 5.0, "entry_of": 5.0, "describes": 1.2, "documented_by": 1.2, "mentions": 1.8, "illustrates": 1.8, "similar_to": 2.0, "rationale_for": 2.0}
FORWARD_IMPACT = {"calls": 2.25, "imports": 2.5, "depends_on": 2.5, "inherits": 1.75, "implements": 1.75, "data_flow": 2.0, "reads_writes": 2.0}
COMMUNITY = {"calls": 0.55, "defines": 0.7, "imports": 0.45, "depends_on": 0.45, "inherits": 1.25, "implements": 1.25, "data_flow": 0.65, "reads_writes": 0.85, "tested_by": 0.6, "member_of": 0.1, "entry_of": 0.1, "describes": 0.75, "documented_by": 0.75, "mentions": 0.75, "illustrates": 0.55, "similar_to": 0.55, "rationale_for": 0.55}
NODE_BOOST = {"function": 1.3, "method": 1.3, "class": 1.3, "type": 1.3, "trait": 1.2, "impl": 1.2, "file": 0.95, "module": 0.95, "document": 0.85, "section": 0.85, "concept": 0.85, "diagram": 0.75, "image": 0.75, "variable": 0.7, "commit": 0.7, "author": 0.7, "hyperedge": 0.7, "flow": 0.4, "package": 0.95}
DEFAULTS = {"transition": 0.5, "path": 1.5, "impact": 1.5, "community": 0.55, "ambiguous_community": 0.15, "boost": 0.8}

NODES = "id long, kind string, name string, qualified_name string, source_uri string, line_start int, line_end int, line_count int, is_test boolean, source_text string, valid_from string, valid_to string"
EDGES = "id long, src long, dst long, kind string, conf_class string, confidence double"


def weight(column, table: dict[str, float], default: float):
    """Weight of a kind column as a constant map lookup, evaluated inside the generated code."""
    from pyspark.sql import functions as F

    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(default))
