"""Links: extraction, resolution, reachability, replacement chains and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIKI = r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"
INLINE = r"\[[^\]]*\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"]*\")?\)"
REFERENCE = r"(?m)^\s{0,3}\[[^\]]+\]:\s*(\S+)"


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, ord, target of wiki links, inline links (targets with one level of parentheses) and references."""
    of = lambda kind, pattern: F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda target, i: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), target.alias("target"))
    )
    found = F.concat(of("wiki", WIKI), of("markdown", INLINE), of("reference", REFERENCE))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("l")).select("doc_id", "l.kind", "l.ord", "l.target")


def resolve(links: DataFrame, files: DataFrame) -> DataFrame:
    """links(src, target) against files(path): resolved path, or a reason: escaping, missing or ambiguous.

    Candidates in order: the target, the target with .md, and the one file of that base name."""
    base = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    names = files.groupBy(base.alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_only"))
    clean = links.withColumn("_t", F.regexp_replace("target", r"[#?].*$", "")).withColumn("_name", F.regexp_extract("_t", r"([^/]+?)(?:\.md)?$", 1))
    exact = files.select(F.col("path").alias("_t"), F.col("path").alias("_exact"))
    with_md = files.where(F.col("path").endswith(".md")).select(F.expr("left(path, length(path) - 3)").alias("_t"), F.col("path").alias("_md"))
    joined = clean.join(exact, "_t", "left").join(with_md, "_t", "left").join(names, "_name", "left")
    escapes = F.col("_t").rlike(r"^[/\\]|(^|/)\.\.(/|$)|^[A-Za-z]:")
    path = F.coalesce("_exact", "_md", F.when((F.col("_n") == 1) & ~F.contains("_t", F.lit("/")), F.col("_only")))
    reason = F.when(escapes, "escaping").when(path.isNotNull(), F.lit(None)).when((F.col("_n") > 1) & ~F.contains("_t", F.lit("/")), "ambiguous").otherwise("missing")
    return joined.select("src", "target", F.when(~escapes, path).alias("path"), reason.alias("reason"))


def reachable(edges: DataFrame, starts: DataFrame, stored) -> DataFrame:
    """node and the least number of steps from any start, over edges(src, dst). Frontier by frontier; each is joined with
    the edges alone and written down, so that plans stay flat."""
    seen = stored(starts.select("node").distinct().withColumn("steps", F.lit(0)), "reach")
    frontier, step = seen, 0
    while True:
        step += 1
        new = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stored(new.join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(step)), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def cycles(edges: DataFrame, stored) -> DataFrame:
    """Nodes on cycles of a graph in which every node has at most one successor: edges(src, dst). Pointers are doubled until
    they have run further than there are nodes; a node is on a cycle if a long run of pointers ends on it. Repeated edges do
    no harm; a node with two successors is refused. What has no predecessor goes first, as it is on no cycle."""
    edges = stored(edges.select("src", "dst").distinct(), "jump")
    if not edges.groupBy("src").count().where("count > 1").isEmpty():
        raise ValueError("a node has several successors")
    jump = stored(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "jump")
    n, length = jump.count(), 1
    while length <= n:
        jump = stored(jump.alias("a").join(jump.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")), "jump")
        length *= 2
    # every node that is still pointed at after so many steps is on a cycle, and so is all that follows it
    return jump.select(F.col("dst").alias("node")).distinct()


def impact(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """page and its number of changes: changes(path, previous_path) hit a source if it is the path, its old name, or a folder
    above either. sources: page, source."""
    ends = changes.select(F.col("path").alias("change"), F.explode(F.array_compact(F.array("path", "previous_path"))).alias("end"))
    parts = F.split("end", "/")
    up = ends.select("change", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("source"))
    return sources.join(up.distinct(), "source").groupBy("page").agg(F.count_distinct("change").alias("n_changes"))


def collisions(moves: DataFrame, existing: DataFrame) -> DataFrame:
    """destination, n_sources and occupied, for destinations of several sources or of files that stand. moves: source,
    destination; a file that stays where it is does not occupy its place."""
    counted = moves.groupBy("destination").agg(F.count(F.lit(1)).alias("n_sources"), F.bool_or(F.col("source") == F.col("destination")).alias("_own"))
    joined = counted.join(existing.select(F.col("path").alias("destination"), F.lit(True).alias("_there")), "destination", "left")
    return joined.withColumn("occupied", F.coalesce("_there", F.lit(False)) & ~F.col("_own")).where("n_sources > 1 or occupied").select("destination", "n_sources", "occupied")


def resolve_unique_name(names: DataFrame) -> DataFrame:
    """name and path of names that one file has."""
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("path")).where("_n = 1").select("name", "path")
