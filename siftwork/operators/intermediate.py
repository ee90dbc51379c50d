"""From Python sources to intermediate nodes, edges, patterns, token sequences and feature vectors, as one plan.

`nodes` gives the rows of all files: syntax trees, cut and numbered in pre-order, classified, with the rows that a file's
flags add. What follows works on those rows: `nodes.edges`, `patterns.hits`, `nodes.token_sequence`, `nodes.metrics`, and
`vectors` for all features of a file. A source without text is a module without children; one that does not
parse is a module of its own with what its bytes show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..sources import tables
from . import nodes as N
from . import patterns as P
from . import structure as R

#: Properties that an intermediate node keeps, besides the flags of its file at the root.
KEPT = "is_async arg_count kwonly_count posonlyargs has_varargs has_kwargs has_defaults decorator_count base_count alias_count import_level has_orelse handler_count item_count generator_count name_count operand_count comparator_count has_starargs has_star_kwargs numeric_magnitude value_type is_slice has_metaclass has_type".split()
AFTER_ALL = (1 << 31) - 1


def cut_below(nodes: DataFrame, keys: list[str], cut: Column, path: str = "path") -> DataFrame:
    """Without the nodes below those that `cut` names; these stay.

    path: child positions from the root (an array of ints), whose order is pre-order. Whatever lies below a node comes
    after its path and before that path with a last position beyond all others, so that one running maximum of such ends
    tells every node whether it is below one that was cut, however deep and however they nest."""
    end = F.when(cut, F.concat(F.col(path), F.array(F.lit(AFTER_ALL))))
    before = Window.partitionBy(*keys).orderBy(path).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("_end", F.max(end).over(before)).where(F.col("_end").isNull() | (F.col(path) > F.col("_end"))).drop("_end")


def renumbered(nodes: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """idx and parent_idx in pre-order of what is left of the trees."""
    rows = tables.written(N.number(nodes.drop("idx", "parent_idx"), keys, path))
    parents = rows.select(*keys, F.col(path).alias("_up"), F.col("idx").alias("parent_idx"))
    up = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
    below = rows.where(F.size(path) > 0).withColumn("_up", up).join(parents, [*keys, "_up"]).drop("_up")
    return below.unionByName(rows.where(F.size(path) == 0).withColumn("parent_idx", F.lit(None).cast("int")))


def files(sources: DataFrame, key: str, text: str = "text") -> DataFrame:
    """What is known of each file as a whole: a column for every flag and number, entropy, blank share, modules and errors. A written table."""
    f = R.python_files(sources, key, text)
    flags = [F.coalesce(F.element_at("flags", k), F.lit(False)).alias(k) for k in R.FLAGS]
    numbers = [F.coalesce(F.element_at("numbers", k), F.lit(0)).alias(k) for k in R.NUMBERS]
    return tables.written(f.select(key, *flags, *numbers, "source_entropy", "blank_ratio", "modules", "parse_errors"))


def nodes(sources: DataFrame, about: DataFrame, key: str, text: str = "text", depth: int = L.IR_DEPTH, cut: Column | None = None) -> DataFrame:
    """key, idx, parent_idx, depth, ir_type, category, risk_level, source, raises and props of every node; a written table.

    about: the files' flags (see `files`). Trees end at `depth`, below nodes that were cut when they were read, and below those that
    `cut` (over node_type, depth, props and path) names. The root has its file's flags among its properties."""
    tree = N.limit_depth(R.python_nodes(sources, key, text, paths=True), depth)
    ended = F.col("node_type") == "DEPTH_LIMIT"
    tree = renumbered(cut_below(tree, [key], ended if cut is None else ended | F.coalesce(cut, F.lit(False))), [key])
    flags = F.map_from_arrays(F.array(*map(F.lit, R.FLAGS)), F.array(*[F.when(F.col(k), "true").otherwise("false") for k in R.FLAGS]))
    of = about.select(key, flags.alias("_flags"), F.lit(0).alias("idx"))
    kept = N.with_depth(N.kept_properties(F.coalesce("props", F.create_map().cast("map<string,string>")), KEPT), F.col("depth"))
    typed = N.classify(tree).withColumn("props", kept).join(of, [key, "idx"], "left")
    typed = typed.withColumn("props", F.when(F.col("_flags").isNull(), F.col("props")).otherwise(F.map_concat("props", F.map_filter("_flags", lambda k, v: (v == "true") & ~F.array_contains(F.map_keys("props"), k)))))
    none = F.lit(None).cast("string")
    own = typed.select(key, "idx", "parent_idx", "depth", "ir_type", "category", "risk_level", none.alias("source"), none.alias("raises"), "props")
    own = tables.written(own)
    last = own.groupBy(key).agg(F.max("idx").alias("last_idx"))
    added = N.added_rows(about.join(last, key), [key]).withColumn("props", F.create_map().cast("map<string,string>"))
    return tables.written(own.unionByName(added.select(*own.columns)))


def vectors(rows: DataFrame, about: DataFrame, key: str) -> DataFrame:
    """All features of each file: of its nodes, of the file itself and of its pattern hits."""
    return N.vector(rows, about, P.hits(rows, [key]), [key])


def summaries(rows: DataFrame, key: str) -> DataFrame:
    """One row a file: counters, number and weight of its edges, its patterns with their places, what they add, its token sequence."""
    edges = N.edges(rows, [key]).groupBy(key).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    place = F.concat("pattern_id", F.lit(":"), F.array_join(F.transform("node_indices", lambda i: i.cast("string")), ","))
    found = P.hits(rows, [key]).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(place)), ";").alias("patterns"), F.sum("risk_boost").alias("extra_risk"))  # at most nineteen
    out = N.metrics(rows, [key]).join(edges, key, "left").join(found, key, "left").join(N.token_sequence(rows, [key]), key)
    return out.fillna({"edges": 0, "weight": 0.0, "patterns": "", "extra_risk": 0})
