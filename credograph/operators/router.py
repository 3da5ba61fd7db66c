"""Which method a graph is given to."""

from __future__ import annotations

from pyspark.sql import DataFrame

from credograph.operators import exact, junction_tree, mean_field, message_passing

#: The width up to which trees are used, and the number of variables above which the original
#: leaves exact ways.
MOST_WIDE, MANY = 20, 2000
METHODS = ("auto", "exact", "junction_tree", "loopy", "trw", "mean_field")


def infer(variables: DataFrame, factors: DataFrame, method: str = "auto", large: str = "mean_field", most_variables: int | None = None) -> tuple[DataFrame, str]:
    """(variable and belief; the method used). ``auto``: a junction tree up to width 20, whatever the
    size, else tree-reweighted propagation. With ``most_variables`` (``MANY`` for the original's rule), a larger graph
    goes to ``large`` (mean_field or loopy) unseen."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method == "auto":
        if most_variables is not None and variables.count() > most_variables:
            method = large
        else:
            try:
                return junction_tree.marginals(variables, factors, MOST_WIDE), "junction_tree"
            except junction_tree.TooWide:
                method = "trw"
    if method == "exact":
        return exact.marginals(variables, factors).select("variable", "belief"), method
    if method == "junction_tree":
        return junction_tree.marginals(variables, factors), method
    if method == "mean_field":
        return mean_field.run(variables, factors)[0], method
    return (message_passing.loopy if method == "loopy" else message_passing.tree_reweighted)(variables, factors), method
