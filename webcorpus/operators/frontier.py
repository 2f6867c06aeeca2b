"""Breadth-first crawl over a corpus of fetched pages.

The reference pops a FIFO queue: each URL is visited once, at most ``max_pages`` visits
(failed and non-HTML ones count), links are enqueued in page order then link order.
Level-synchronous BFS gives exactly that order: a URL's place in its level is its first
parent's place, then the link's position, kept as a short array of numbers; whenever it
grows past ``MAX_PLACE`` the level is numbered anew (``windows.number_rows``).

One round joins the frontier with the adjacency lists, one or several levels deep, keeps
the first place per URL (a grouped aggregate) and drops what has been visited.  Lists are
hash-partitioned by page, visited URLs by URL, both checkpointed with their partitioning,
so a round shuffles only the rows of the round.  While levels stay small and do not grow,
a round takes several levels at once; their number changes the speed only.  Where that goes on,
chains of pages that lead to a single further page are walked by pointer doubling (``_Chains``):
a chain of any length takes a number of steps that grows with the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import checkpoint_dir
from .exclusion import exclude_by_table
from .html import parse_pages
from .links import anchors, links_from_anchors, summary_columns
from .windows import number_rows


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exclude_urls(df: DataFrame, patterns: list[str] | DataFrame, url_col: str = "url") -> DataFrame:
    """drop URLs matching any of the regexes: a short list is one alternation; a table (column ``pattern``) of
    any length goes through ``exclusion.exclude_by_table``."""
    if isinstance(patterns, DataFrame):
        return exclude_by_table(df, patterns, url_col)
    if not patterns:
        return df
    joined = "|".join(f"(?:{p})" for p in patterns)
    return df.where(~F.coalesce(F.col(url_col).rlike(joined), F.lit(False)))


#: Levels of a round at most, rows of a level up to which a round may have several, numbers in a place.
MAX_HOPS, SMALL_LEVEL, MAX_PLACE = 8, 10_000, 16


def _seed_rows(spark: SparkSession, seeds) -> DataFrame:
    """url, seq: a URL, URLs in order, or a table with ``url`` (in order of ``seq`` if it has one, else of url)."""
    if isinstance(seeds, str):
        seeds = [seeds]
    if isinstance(seeds, DataFrame):
        rows = seeds.select("url", (F.col("seq").cast("bigint") if "seq" in seeds.columns else F.lit(0).cast("bigint")).alias("seq"))
    else:
        rows = spark.createDataFrame(list(enumerate(seeds)), "seq bigint, url string").select("url", "seq")
    return rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.min("seq").alias("seq"))


def in_scope(edges: DataFrame, seeds: DataFrame, scope: str, target: str = "target") -> DataFrame:
    """edges to targets of the seeds' sites: 'origin' (same scheme and host), 'prefix' (the target begins with a
    seed's scheme://host, so look-alike hosts pass: the reference's test, Q4) or 'any'.

    Only distinct origins meet the seeds' ones, never links; a row keeps its place whichever site it is of."""
    if scope == "any":
        return edges
    bases = seeds.select(U.origin("url").alias("base")).distinct()
    keyed = edges.withColumn("_origin", U.origin(target))
    if scope == "origin":
        return keyed.join(bases, F.col("_origin") == F.col("base"), "left_semi").drop("_origin")
    found = keyed.select("_origin").distinct().where("_origin <> ''")
    heads = found.select("_origin", F.explode(F.transform(F.sequence(F.lit(1), F.length("_origin")), lambda n: F.left("_origin", n))).alias("base"))
    ok = heads.join(bases, "base", "left_semi").select("_origin").distinct()
    return keyed.join(ok, "_origin", "left_semi").drop("_origin")


def crawl_edges(info: DataFrame, seeds: DataFrame, scope: str = "origin", drop_fragment: bool = True,
                exclude: list[str] | DataFrame | None = None) -> DataFrame:
    """H4 + F2 + F4 + U8 (+F5): (page_id, pos, target) for every crawlable link of every page, the first place per
    (page, target) (``info`` carries each page's ``anchors`` array)."""
    links = links_from_anchors(info)
    href = F.col("href")
    e = links.where(~href.startswith("#") & ~href.startswith("javascript:"))
    target = U.strip_query("url")
    if drop_fragment:
        target = U.drop_fragment(target)
    e = in_scope(e.select("page_id", "pos", "url"), seeds, scope, "url")
    e = e.select("page_id", "pos", target.alias("target")).groupBy("page_id", "target").agg(F.min("pos").alias("pos"))
    return exclude_urls(e, exclude, "target") if exclude is not None else e


def _visits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, status_code, content_type, outcome: what a visit of each page of the corpus gives."""
    status = F.col("status_code").cast("int") if "status_code" in pages.columns else F.lit(200)
    kind = F.col("content_type") if "content_type" in pages.columns else F.lit("text/html")
    rows = pages.select("page_id", "url", "html", status.alias("status_code"), kind.alias("content_type"))
    html = F.coalesce(F.col("content_type").contains("text/html"), F.lit(False))
    return rows.withColumn("outcome", F.when(F.col("status_code").isNull(), "failed").when(html, "page").otherwise("not_html"))


def crawl(pages: DataFrame, seeds, max_pages: int | None = None, scope: str = "origin", drop_fragment: bool = True,
          exclude: list[str] | DataFrame | None = None, partitions: int | None = None, keep_failed: bool = False) -> DataFrame:
    """BFS from ``seeds`` over ``pages(page_id, url, html[, status_code, content_type])``.

    ``seeds`` is a URL, a list of URLs in order, or a table (url[, seq]); they form the first level. Every URL is visited once, in FIFO order, until
    ``max_pages`` visits (None: no bound). A page answers for all URLs of its key (the smallest page_id of a key does). A visit of a
    URL without a page or without a status is failed; one whose content type does not contain 'text/html' is not_html;
    both use budget, have no links and stay out of the result. Any status counts as an answer, as in the reference. Without the columns
    every page is a 200 'text/html'.

    Returns the visited pages: url, depth, order (0, 1, 2, … over all visits), page_id, title, description, status_code,
    content_type; with ``keep_failed`` all visits and their ``outcome``. No pages or seeds: no rows.
    """
    spark = pages.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = _visits(pages)
    # one parse, of the pages whose html counts: title, description and anchors (small next to html)
    parsed = parse_pages(visits.withColumn("html", F.when(F.col("outcome") == "page", F.col("html"))))
    info = parsed.select("page_id", "url", "status_code", "content_type", "outcome", *summary_columns(F.col("nodes")), anchors("nodes").alias("anchors"))
    info = info.checkpoint()
    keys = (info.select(U.url_key("url").alias("key"), "page_id").groupBy("key").agg(F.min("page_id").alias("page_id"))
            .repartition(n, "key").checkpoint())
    seed_rows = _seed_rows(spark, seeds)

    def with_page(df: DataFrame, url: str) -> DataFrame:
        return df.withColumn("key", U.url_key(url)).join(keys, "key", "left").drop("key")

    # adjacency lists; each target is looked up in the corpus once, here, instead of once per level. A distinct
    # (page, target) has one row, and a hot target is looked up once
    edges = crawl_edges(info.where("outcome = 'page'"), seed_rows, scope, drop_fragment, exclude)
    known = with_page(edges.select("target").distinct(), "target").withColumnRenamed("page_id", "target_page_id")
    lists = edges.join(known, "target").repartition(n, "page_id").groupBy("page_id").agg(
        F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), "target", "target_page_id")).alias("links"))
    lists = lists.sortWithinPartitions("page_id").checkpoint()

    first = number_rows(seed_rows, ["seq", "url"], "number")
    level = with_page(first.select("url", F.array("number").alias("place")), "url")
    level = level.select("url", "place", "page_id", F.lit(0).alias("depth")).repartition(n, "url").checkpoint()
    seen, taken, hops = [level.select("url", "page_id", "depth")], [level], 1
    size, used, depth, width = level.count(), 0, 0, 1
    chains, idle, wait = None, 0, 1  # rounds since the last walk, rounds until the next one
    if max_pages is not None and size > max_pages:
        return _result(_cut(level, max_pages), info, keep_failed)
    used = size
    while size and (max_pages is None or used < max_pages):
        if width > MAX_PLACE:  # level: all visits of the greatest depth
            level, width = number_rows(level, ["place"], "number").withColumn("place", F.array("number")).drop("number"), 1
        walk = hops == MAX_HOPS and idle >= wait
        if walk:
            chains = chains or _Chains(lists, n)
            new, levels = chains.walk(level, depth, _union(seen), None if max_pages is None else max_pages - used)
        else:
            new, levels = _round(level, lists, depth, hops, n), hops
        for part in seen:
            new = new.join(part.select("url"), "url", "left_anti")
        new = new.checkpoint()
        found, after = new.agg(F.count("*"), F.count_if(F.col("depth") == depth + levels)).first()
        if max_pages is not None and used + found > max_pages:
            taken.append(_cut(new, max_pages - used))
            return _result(_union(taken), info, keep_failed)
        used += found
        taken.append(new)
        seen.append(new.select("url", "page_id", "depth"))
        if len(seen) > 6:  # keeps plans short: few parts, all partitioned by url
            seen = [_union(seen).repartition(n, "url").checkpoint()]
        if len(taken) > 24:
            taken = [_union(taken).checkpoint()]
        grown = after > 1.5 * max(1, size)
        if walk:
            idle, wait = 0, 0 if levels > 4 * MAX_HOPS else 2 * wait + 1
        else:
            idle += hops == MAX_HOPS
        depth, width, size = depth + levels, 2 if walk else width + hops, after
        level = new.where(F.col("depth") == depth)
        hops = min(MAX_HOPS, 2 * hops) if size <= SMALL_LEVEL and not grown else 1
    return _result(_union(taken), info, keep_failed)


def _round(level: DataFrame, lists: DataFrame, depth: int, hops: int, n: int) -> DataFrame:
    """First places of the URLs reached from ``level`` in up to ``hops`` steps (visited ones among them).

    A URL that was visited before may be passed again; its links lead to no place that a shorter way does not."""
    rows = level.select("url", F.struct(F.lit(depth).alias("depth"), "place", "page_id").alias("v"))
    for hop in range(hops):
        at_end = rows.select("url", "v", F.when(F.col("v.depth") == depth + hop, F.col("v.page_id")).alias("page_id"))
        joined = at_end.join(lists, "page_id", "left")
        step = F.transform("links", lambda x: F.struct(x.target.alias("url"), F.struct(
            F.lit(depth + hop + 1).alias("depth"), F.concat("v.place", F.array(x.pos)).alias("place"), x.target_page_id.alias("page_id")).alias("v")))
        both = F.concat(F.array(F.struct("url", "v")), F.coalesce(step, F.array().cast("array<struct<url:string,v:struct<depth:int,place:array<bigint>,page_id:bigint>>>")))
        rows = joined.select(F.inline(both)).repartition(n, "url").groupBy("url").agg(F.min("v").alias("v"))
    return rows.select("url", "v.place", "v.page_id", "v.depth").where(F.col("depth") > depth)


class _Chains:
    """Walks along chains: runs of pages with links to one other page that has links itself (however many links lead to
    URLs outside the corpus or to pages without links).

    ``jumps[k]`` has the page that 2**k steps along a chain lead to; each is made of the one before when a walk
    first needs it. A walk ends at the first level that has a fork, an unvisited page with several ways on."""

    def __init__(self, lists: DataFrame, n: int):
        self.lists, self.n = lists, n
        ways = lists.select("page_id", F.explode("links.target_page_id").alias("to")).where(F.col("to") != F.col("page_id")).distinct()
        ways = ways.join(lists.select(F.col("page_id").alias("to")), "to", "left_semi")
        ways = ways.groupBy("page_id").agg(F.min("to").alias("to"), F.count("*").alias("n")).checkpoint()
        self.forks = ways.where("n > 1").select("page_id")
        self.jumps = [ways.where("n = 1").select("page_id", "to")]

    def _jump(self, k: int) -> DataFrame:
        while len(self.jumps) <= k:
            half = self.jumps[-1]
            twice = half.withColumnRenamed("to", "middle").join(half.withColumnRenamed("page_id", "middle"), "middle")
            self.jumps.append(twice.select("page_id", "to").checkpoint())
        return self.jumps[k]

    def walk(self, level: DataFrame, depth: int, seen: DataFrame, budget: int | None = None) -> tuple[DataFrame, int]:
        """First places of the URLs reached from ``level``, of as many levels as are returned with them (at least one; with a
        ``budget`` not many more than its visits can fill). A chain's pages keep the place of the visit that it starts from."""
        first = number_rows(level.where("page_id IS NOT NULL").select("page_id", "place"), ["place"], "start", min(self.n, 8))  # a small level
        at = first.groupBy("page_id").agg(F.min(F.struct(F.lit(0).cast("bigint").alias("t"), "start")).alias("v"))
        at = at.checkpoint()  # partitions follow the rows here (AQE): most steps are small
        size, k = at.count(), 0
        visited = seen.where((F.col("depth") < depth) & F.col("page_id").isNotNull()).select("page_id")
        while True:  # at: the pages up to 2**k - 1 steps from the level, the first way to each
            forks = at.join(self.forks, "page_id", "left_semi")
            last = forks.agg(F.min("v.t")).first()[0]
            if last is not None and last < (1 << k):
                last = forks.join(visited, "page_id", "left_anti").agg(F.min("v.t")).first()[0]
            if last is not None:
                break
            if budget is not None and (1 << k) > budget:
                last = (1 << k) - 1
                break
            step = F.struct((F.col("v.t") + (1 << k)).alias("t"), F.col("v.start").alias("start")).alias("v")
            more = at.join(self._jump(k), "page_id").select(F.col("to").alias("page_id"), step)
            at = at.unionByName(more).groupBy("page_id").agg(F.min("v").alias("v")).checkpoint()
            k, before, size = k + 1, size, at.count()
            if size == before:  # nothing further: the chains end or run in circles
                last = at.agg(F.max("v.t")).first()[0]
                break
        last = last or 0
        links = F.transform("links", lambda x: F.struct(x.target.alias("url"), F.struct(
            (F.col("v.t") + (depth + 1)).cast("int").alias("depth"), F.array("v.start", x.pos).alias("place"), x.target_page_id.alias("page_id")).alias("v")))
        rows = at.where(F.col("v.t") <= last).join(self.lists, "page_id").select(F.inline(links))
        rows = rows.repartition(self.n, "url").groupBy("url").agg(F.min("v").alias("v"))
        return rows.select("url", "v.place", "v.page_id", "v.depth"), last + 1


def _cut(visits: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` visits of a level, or of the levels of a round."""
    return number_rows(visits, ["depth", "place"], "number").where(F.col("number") < budget).drop("number")


def _result(taken: DataFrame, info: DataFrame, keep_failed: bool) -> DataFrame:
    numbered = number_rows(taken, ["depth", "place"], "order").select("url", "depth", "order", "page_id")
    out = numbered.join(info.select("page_id", "title", "description", "status_code", "content_type", "outcome"), "page_id", "left")
    out = out.withColumn("outcome", F.coalesce("outcome", F.lit("failed")))
    is_page = F.col("outcome") == "page"
    columns = ["url", "depth", "order", "page_id", F.when(is_page, F.col("title")).alias("title"),
               F.when(is_page, F.col("description")).alias("description"), "status_code", "content_type"]
    return out.select(*columns, "outcome") if keep_failed else out.where(is_page).select(*columns)
