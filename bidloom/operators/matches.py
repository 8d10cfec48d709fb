"""Nodes held against an answer key: by the path of markers at the end of their ids, or by their first words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import apart, cut

#: Characters of a key's first words, blanks aside, that a node's text must hold, after so many others at most.
PREFIX, SLACK = 24, 12
CONTAINERS = ("document", "subdocument")


def marker_path(key_id: Column) -> Column:
    """The forms of each segment that a node's id must end with, array<array<string>>: "X:PartA:Item1(b)" has [PA, TA], [1, (1)],
    [(b)]; empty for a whole document; null where a segment is no Part, table, item, paragraph or row."""
    marked = r"^(?:Item|Para|Row)?([0-9]+(?:[.][0-9]+)*|[(][^)]+[)])((?:[(][^)]+[)])*)$"

    def forms(s: Column) -> Column:
        scope = F.regexp_extract(s, "^(?:Part|Table)([A-Z0-9]+)$", 1)
        head = F.regexp_replace(F.regexp_extract(s, marked, 1), "[()]", "")
        items = F.transform(F.regexp_extract_all(F.regexp_extract(s, marked, 2), F.lit("[(][^)]+[)]"), F.lit(0)), lambda x: F.array(x))
        own = F.array(F.array(head, F.concat(F.lit("("), head, F.lit(")"))))
        return F.when(scope != "", F.array(F.array(F.concat(F.lit("P"), scope), F.concat(F.lit("T"), scope)))).when((head != "") & ~s.startswith("Note"), F.concat(own, items))

    parts = F.split(key_id, ":")
    every = F.transform(F.slice(parts, 2, F.size(parts)), forms)
    return F.when(F.size(parts) == 1, F.array().cast("array<array<string>>")).when(~F.exists(every, lambda x: x.isNull()), F.flatten(every))


def _squashed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def opens_with(text: Column, first_words: Column) -> Column:
    """The text has the first words at its beginning or shortly after it."""
    words = F.left(_squashed(first_words), F.lit(PREFIX))
    return F.call_function("instr", _squashed(text), words).between(1, SLACK + 1)


def _plain(form: Column) -> Column:
    """What the forms of a segment have in common: brackets and the kind of scope aside."""
    return F.regexp_replace(F.regexp_replace(form, "[()]", ""), "^[PT](?=[A-Z0-9]+$)", "P")


def key_matches(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, key_id, marked, node_id, why): the node found for every node of the key.

    keys: project, key_id, parent_id, file, page, first_words; nodes: project, node_id, kind, file, page, text, ord. A key node
    with a path of markers takes a node of its page whose id ends with it, repeats' numbers aside; of several one that
    opens with its first words, then the first. One without takes the first node of its page that opens with its first
    words, within the node of the nearest marked key node above, if there is one. Ends of ids are joined by equality
    and then held against the forms.
    """
    keys = cut(keys.withColumn("path", marker_path(F.col("key_id"))), "keys")
    segments = F.transform(F.slice(F.split("node_id", ":"), 2, F.size(F.split("node_id", ":"))), lambda s: F.regexp_replace(s, "#[0-9]+$", ""))
    n = nodes.withColumn("segments", segments)
    at = F.sequence(F.when(F.col("kind").isin(*CONTAINERS), 0).otherwise(1), F.greatest(F.size("segments"), F.when(F.col("kind").isin(*CONTAINERS), 0).otherwise(1)))
    n = n.withColumn("n", F.explode(at)).where("n <= size(segments)")
    n = n.withColumn("tail", F.slice("segments", F.size("segments") - F.col("n") + 1, F.col("n"))).withColumn("end", F.array_join(F.transform("tail", _plain), ":"))
    k = keys.where("path is not null").select("project", "key_id", "file", "page", "first_words", "path", F.size("path").alias("n"), F.array_join(F.transform("path", lambda f: _plain(f[0])), ":").alias("end"))
    hit = k.join(apart(n.select("project", "file", "page", "n", "end", "tail", "node_id", "text", "ord")), ["project", "file", "page", "n", "end"])
    hit = hit.where(F.forall(F.zip_with("tail", "path", lambda s, f: F.array_contains(f, s)), lambda x: x))
    best = hit.groupBy("project", "key_id").agg(F.min_by("node_id", F.struct(~opens_with(F.col("text"), F.col("first_words")), F.col("ord"))).alias("node_id"))
    marked = cut(k.select("project", "key_id").join(apart(best), ["project", "key_id"], "left"), "marked")

    # Up from each key node without a path to the nearest with one, a level a round.
    up = keys.select("project", F.col("key_id").alias("above"), F.col("parent_id").alias("next"), F.col("path").isNotNull().alias("there"))
    open_ = keys.where("path is null").select("project", "key_id", "file", "page", "first_words", F.col("parent_id").alias("above"))
    done = open_.where("above is null")
    open_ = open_.where("above is not null")
    while not open_.isEmpty():
        step = cut(open_.join(apart(up), ["project", "above"], "left"), "climb")
        found = step.where("there or there is null").withColumn("above", F.when(F.col("there"), F.col("above")))
        more = step.where("not there").withColumn("above", F.col("next"))
        done = done.unionByName(found.select(done.columns)).unionByName(more.where("above is null").select(done.columns))
        open_ = more.where("above is not null").select(done.columns)
    own = done.join(apart(marked.select("project", F.col("key_id").alias("above"), F.col("node_id").alias("anchor"))), ["project", "above"], "left")
    p = F.split("node_id", ":")
    line = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), ":"))
    inside = nodes.select("project", "file", "page", "node_id", "text", "ord", F.explode(F.array_append(line, F.lit(""))).alias("anchor"))
    free = own.where(F.col("above").isNull() | F.col("anchor").isNotNull()).withColumn("anchor", F.coalesce("anchor", F.lit("")))
    hit = free.join(apart(inside), ["project", "file", "page", "anchor"]).where(opens_with(F.col("text"), F.col("first_words")))
    best = hit.groupBy("project", "key_id").agg(F.min_by("node_id", "ord").alias("node_id"))
    lost = F.when(F.col("node_id").isNotNull(), "").when(F.col("above").isNull(), "first words not on this page").when(F.col("anchor").isNull(), "marked ancestor not found").otherwise("first words not inside the ancestor on this page")
    rest = own.join(apart(best), ["project", "key_id"], "left").select("project", "key_id", F.lit(False).alias("marked"), "node_id", lost.alias("why"))
    why = F.when(F.col("node_id").isNull(), "no node with this path on this page").otherwise("")
    return marked.select("project", "key_id", F.lit(True).alias("marked"), "node_id", why.alias("why")).unionByName(rest)
