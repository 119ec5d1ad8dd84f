"""Registered queries over the driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import ignore_rules, paths
from lodestone.operators import graph, incremental, overlay, status, text
from lodestone.operators.storage import cut
from lodestone.plans import project
from lodestone.sources import assets, config_files, finders, trace, vcs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT 'c' || c_custkey AS id, r_name || '/' || n_name || '/' || c_name AS full_path, 2 AS depth
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'r' || r_regionkey, r_name, 0 FROM region""")
def dir_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory tree's full paths."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    nodes = _t(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nodes = nodes.union(_t(spark, sf_dir, "nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name"))
    nodes = nodes.union(_t(spark, sf_dir, "customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), "c_name"))
    return graph.full_paths(nodes)


def _part_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").where("p_partkey > 0")
    return part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 4).alias("dst"))


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS origin, p_partkey AS node, 0 AS depth FROM part
UNION ALL SELECT origin, node // 4, depth + 1 FROM a WHERE node > 0 AND depth < 50)
SELECT origin, node, min(depth) AS depth FROM a GROUP BY ALL""")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors with their least depth, to depth 50."""
    seeds = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    return graph.reach(seeds, _part_parents(spark, sf_dir), 50)


@query("""WITH RECURSIVE d AS (SELECT CAST(5 AS BIGINT) AS node UNION SELECT p_partkey FROM d JOIN part ON p_partkey // 4 = node WHERE p_partkey > 0)
SELECT node, p_name FROM d JOIN part ON p_partkey = node""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes derived from one, transitively."""
    down = _part_parents(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = graph.reach(spark.range(5, 6).select(F.col("id").alias("origin"), F.col("id").alias("node")), down)
    return found.join(_t(spark, sf_dir, "part"), found["node"] == F.col("p_partkey")).select("node", "p_name")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem WHERE l_returnflag = 'R'
UNION SELECT DISTINCT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem WHERE l_returnflag = 'A'),
r AS (SELECT CAST(0 AS BIGINT) AS node UNION SELECT dst FROM r JOIN e ON src = node)
SELECT node FROM r""")
def reachability_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability over a cyclic graph: what a file includes, transitively. Parts lead to suppliers by returned lines, suppliers to parts by accepted ones."""
    lines = _t(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("part"), (F.col("l_suppkey") * 2 + 1).alias("supplier"), "l_returnflag")
    to_supplier = lines.where("l_returnflag = 'R'").select(F.col("part").alias("src"), F.col("supplier").alias("dst"))
    edges = to_supplier.union(lines.where("l_returnflag = 'A'").select("supplier", "part")).distinct()
    return graph.reach(spark.range(1).select(F.col("id").alias("origin"), F.col("id").alias("node")), cut(edges)).select("node")


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS origin, p_partkey AS node, 0 AS depth FROM part
UNION ALL SELECT origin, node // 4, depth + 1 FROM a WHERE node > 0),
m AS (SELECT a.origin, l_orderkey, l_linenumber, l_quantity, depth, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS rank
  FROM a JOIN lineitem ON l_partkey = a.node)
SELECT origin, l_orderkey AS best_order, l_linenumber AS best_line, depth AS best_depth FROM m
QUALIFY row_number() OVER (PARTITION BY origin ORDER BY depth, rank, l_orderkey, l_linenumber) = 1""")
def inheritance_best_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest definition up the chain, ranked within a level. A node's best line is picked before the join, so a root that all reach adds a row an origin."""
    seeds = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("origin"), F.col("p_partkey").alias("node"))
    up = graph.reach(seeds, _part_parents(spark, sf_dir))
    rank = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), "l_orderkey", "l_linenumber", "l_returnflag")
    own = graph.best_per(lines, ["node"], [rank, F.col("l_orderkey"), F.col("l_linenumber")])
    best = graph.best_per(up.join(own, "node"), ["origin"], [F.col("depth"), rank, F.col("l_orderkey"), F.col("l_linenumber")])
    return best.select("origin", F.col("l_orderkey").alias("best_order"), F.col("l_linenumber").alias("best_line"), F.col("depth").alias("best_depth"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%re%' AND p_name ILIKE '%o%' ORDER BY p_partkey LIMIT 500")
def token_and_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token in the name; the first 500."""
    return _t(spark, sf_dir, "part").where(paths.matches_all(F.col("p_name"), "re o")).select("p_partkey", "p_name", "p_brand").orderBy("p_partkey").limit(500)


@query(r"""SELECT doc_id, lang FROM documents WHERE list_contains(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), 'the')
AND list_bool_or(list_transform(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: starts_with(t, 'ther')))""")
def symbol_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text match of a word and a prefix."""
    return text.match(_t(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "the ther*", ["text"]).select("doc_id", "lang")


@query("""SELECT page_id, url FROM pages WHERE contains(html, 'class="ad"') AND contains(html, 'lang="de"')""")
def content_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte search in file contents."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", "html")
    return text.grep(text.grep(pages, "html", 'class="ad"'), "html", 'lang="de"').select("page_id", "url")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) - 1 AS pos FROM pages""")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in file contents, in order."""
    return text.extracted(_t(spark, sf_dir, "pages").select("page_id", "html"), "html", 'href="([^"]+)"', "href").select("page_id", "href", F.col("pos").cast("long").alias("pos"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
roots AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) AS root FROM u UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/?#]+)/', 1) FROM u)
SELECT page_id, path, max_by(root, length(root)) AS root FROM u JOIN roots ON (path = root OR starts_with(path, root || '/')) AND root <> '' GROUP BY ALL""")
def longest_prefix_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to the deepest module that holds them."""
    u = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    roots = u.select(F.regexp_extract("path", "^([^/]+)", 1).alias("root")).union(u.select(F.regexp_extract("path", "^([^/]+/[^/?#]+)/", 1))).distinct().where("root <> ''")
    return paths.longest_prefix(u, roots.withColumn("name", F.col("root"))).where("root is not null").select("page_id", "path", "root")


@query("""WITH k AS (SELECT p_name, p_brand, p_type, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY ALL)
SELECT p_partkey, CASE WHEN n = 1 THEN id ELSE -1 END AS resolved FROM part JOIN k USING (p_name, p_brand, p_type)""")
def unique_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference by name resolves only where the name is unique."""
    part = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\u0001", "p_name", "p_brand", "p_type").alias("full"))
    return incremental.resolve_unique(part, "full", part, "full", "p_partkey", "resolved").select("p_partkey", F.coalesce("resolved", F.lit(-1)).alias("resolved"))


@query("""SELECT n_name, s_suppkey AS best_supplier, s_name AS best_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_acctbal > 0 THEN 1 ELSE 2 END, length(s_name), s_suppkey) = 1""")
def pick_best_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each key by a ranked order."""
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey", "s_name", "s_acctbal")
    tier = F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 0, 1).otherwise(2)
    return graph.best_per(rows, ["n_name"], [tier, F.length("s_name"), F.col("s_suppkey")]).select("n_name", F.col("s_suppkey").alias("best_supplier"), F.col("s_name").alias("best_name"))


@query("""SELECT p_brand, p_type, count(*) AS n, string_agg(p_partkey || ':' || p_name, ',' ORDER BY p_partkey) AS items FROM part WHERE p_size < 20 GROUP BY ALL""")
def classes_in_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group as an ordered list."""
    items = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    grouped = _t(spark, sf_dir, "part").where("p_size < 20").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), items.alias("items"))
    return grouped.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["p_partkey"].cast("string"), x["p_name"])), ","))


_INTERVALS = """SELECT o_custkey AS k, min(o_orderdate) AS lo, max(o_orderdate) AS hi, 'all' AS name FROM orders GROUP BY 1
UNION ALL SELECT o_custkey, min(o_orderdate), max(o_orderdate), 'y' || year(o_orderdate) FROM orders GROUP BY o_custkey, year(o_orderdate)"""


@query(f"""WITH i AS ({_INTERVALS})
SELECT o_orderkey, arg_max(name, lo) AS inner_name FROM (SELECT o_orderkey, i.name, (lo, -epoch(hi), name) AS lo FROM orders JOIN i ON k = o_custkey AND o_orderdate BETWEEN lo AND hi) GROUP BY 1""")
def enclosing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost interval that holds a point: greatest start wins. The equi-key keeps the interval test small."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    span = lambda keys, name: orders.groupBy(*keys).agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi")).select(F.col("o_custkey").alias("k"), "lo", "hi", name.alias("name"))
    spans = span(["o_custkey"], F.lit("all")).union(span(["o_custkey", F.year("o_orderdate").alias("y")], F.concat(F.lit("y"), F.col("y"))))
    held = orders.join(spans, (F.col("k") == F.col("o_custkey")) & F.col("o_orderdate").between(F.col("lo"), F.col("hi")))
    return held.groupBy("o_orderkey").agg(F.max_by("name", F.struct("lo", -F.unix_timestamp("hi"), "name")).alias("inner_name"))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN '+' WHEN 'error' THEN '!' WHEN 'signup' THEN '-' ELSE '' END AS op,
  CAST(event_id % 7 AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT * FROM (WITH RECURSIVE f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS v FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT f.user_id, s.n, CASE op WHEN '!' THEN [] WHEN '+' THEN list_append(v, value) WHEN '-' THEN list_filter(v, lambda x: x <> value) ELSE [value] END
  FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1) SELECT * FROM f))
SELECT user_id, coalesce(array_to_string(arg_max(v, n), ','), '') AS folded, max(n) AS steps FROM r GROUP BY user_id""")
def ini_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered fold of set, append, remove and clear."""
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "+").when(kind == "error", "!").when(kind == "signup", "-").otherwise("")
    rows = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", op.alias("op"), (F.col("event_id") % 7).cast("string").alias("value"))
    out = overlay.fold(rows, ["user_id"], ["ts", "event_id"])
    return out.select("user_id", F.array_join("values", ",").alias("folded"), "steps")


@query("""WITH need AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 40),
have AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity <= 25)
SELECT n.c AS custkey, n.p AS partkey, (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = n.p) AS best FROM need n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.c = n.c AND h.p = n.p)""")
def missing_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required minus covered, with the best provider of each."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    pairs = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    keys = [F.col("o_custkey").alias("custkey"), F.col("l_partkey").alias("partkey")]
    need, have = pairs.where("l_quantity > 40").select(*keys).distinct(), pairs.where("l_quantity <= 25").select(*keys)
    best = lines.groupBy(F.col("l_partkey").alias("partkey")).agg(F.min("l_suppkey").alias("best"))
    return need.join(have, ["custkey", "partkey"], "left_anti").join(best, "partkey").select("custkey", "partkey", "best")


@query(r"""SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/]+)', 1) LIKE '%.example.org'""")
def asset_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that end with a name: the last segments as an equality."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return _t(spark, sf_dir, "pages").where(F.substring_index(host, ".", -2) == "example.org").where(F.size(F.split(host, r"\.")) > 2).select("page_id", "url")


@query("""WITH o AS (SELECT o_custkey AS key, count(*) AS stamp FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT o_custkey AS key, count(*) AS stamp FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'deleted' WHEN o.stamp = n.stamp THEN 'unchanged' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.key = n.key""")
def files_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots: customers with finished and with open orders, stamped by their number."""
    counts = lambda status: _t(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("stamp"))
    return incremental.changes(counts("F"), counts("O"), "key", "stamp")


@query("""WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) AS ts FROM events),
r AS (SELECT user_id, min(ts) AS ts FROM s GROUP BY 1 UNION ALL
  SELECT user_id, ts FROM (SELECT r.user_id, min(s.ts) AS ts FROM r JOIN s ON s.user_id = r.user_id AND s.ts >= r.ts + 21600000000 GROUP BY r.user_id))
SELECT user_id, ts FROM r""")
def debounce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least six hours after the last accepted one of their key."""
    rows = _t(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return incremental.debounced(rows, "user_id", "ts", 6 * 3600 * 1_000_000)


@query("""SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20""")
def commit_log_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of each kind."""
    rows = _t(spark, sf_dir, "events").select("event_type", "event_id", "value", "ts")
    top = F.expr("row_number() over (partition by event_type order by ts desc, event_id desc)")  # Spark keeps each task's first 20 before the shuffle
    return rows.withColumn("n", top).where("n <= 20").select("event_type", "event_id", "value")


@query("""SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 500 AS BIGINT) AS chunk FROM orders""")
def chunked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in ordered batches of 500."""
    return incremental.chunked(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 500, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "chunk")


@query("""SELECT DISTINCT c_mktsegment AS scope, l_partkey AS module FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def scope_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of a scope with their dependencies."""
    scope = _t(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", F.col("c_mktsegment").alias("scope"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("module"))
    return scope.join(orders, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("scope", "module").distinct()


@query("""SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'english' WHEN contains(lower(url), '/de/') THEN 'german' WHEN contains(lower(url), '?') THEN 'query' ELSE 'other' END AS kind,
  lower(regexp_extract(split_part(url, '/', -1), '\\.([^.]+)$', 1)) AS ext FROM pages""")
def ext_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category ladder and the extension."""
    u = F.lower("url")
    kind = F.when(u.contains("/en/"), "english").when(u.contains("/de/"), "german").when(u.contains("?"), "query").otherwise("other")
    return _t(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), paths.extension(F.col("url")).alias("ext"))


_ASSETS = """SELECT '/Game/S' || l_suppkey AS asset, '/Script/Parts.Part' || l_partkey AS target, CASE l_returnflag WHEN 'R' THEN 'derived' WHEN 'A' THEN 'functions' ELSE 'references' END AS kind FROM lineitem"""


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as assets: lines of each return flag as imports, parents and functions."""
    lines = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("/Game/S"), "l_suppkey").alias("asset_path"), F.concat(F.lit("/Script/Parts.Part"), "l_partkey").alias("t"), "l_returnflag").distinct()
    flag, none = F.col("l_returnflag"), F.array().cast("array<string>")
    return lines.select("asset_path", F.when(flag == "R", F.col("t")).alias("parent_class"), F.when(flag == "N", F.array("t")).otherwise(none).alias("imports"), F.when(flag == "A", F.array("t")).otherwise(none).alias("functions"))


@query(f"SELECT DISTINCT kind, lower(target) AS target, lower(asset) AS asset FROM ({_ASSETS})")
def asset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reference maps as one edge table."""
    return assets.edges(_assets(spark, sf_dir))


@query(f"SELECT DISTINCT CASE kind WHEN 'derived' THEN 'derived' ELSE 'references' END AS relation, lower(asset) AS asset FROM ({_ASSETS}) WHERE target = '/Script/Parts.Part7'")
def asset_graph_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What uses or derives from one class."""
    return assets.usages(assets.edges(_assets(spark, sf_dir)), "/Script/Parts.Part7")


@query(r"""SELECT page_id, (regexp_matches(rel, '(^|/)[^/]*[.]html$') AND NOT regexp_matches(rel, '(^|/)index[^/]*[.]html$')) OR regexp_matches(rel, '^[^/]+/de(/|$)') OR regexp_matches(rel, '^[^/]+/[^/]*7(/|$)') AS ignored
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS rel FROM pages)""")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore rules: a pattern with an exception, a folder below any top folder, and an anchored pattern."""
    rules = ignore_rules.parse("*.html\n!index*.html\n*/de/\n/*/*7\n")
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return _t(spark, sf_dir, "pages").select("page_id", ignore_rules.ignored(rel, rules).alias("ignored"))


@query("""WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS at, event_type FROM events)
SELECT event_id, (SELECT max_by(s.event_id, (s.at, s.event_id)) FROM e s WHERE s.user_id = x.user_id AND s.event_type = 'signup' AND s.at < x.at) AS started FROM e x WHERE event_type = 'error'""")
def exit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each end with the name of the last start of its key before it."""
    kind = F.when(F.col("event_type") == "signup", "started").otherwise("exited")
    rows = _t(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error")).select(
        F.lit("all").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), kind.alias("kind"), F.col("user_id").alias("pid"), F.col("event_id").alias("text")
    )
    return trace.with_names(rows).where("kind = 'exited'").select(F.col("text").alias("event_id"), F.col("process").alias("started"))


@query("""SELECT event_id, printf('%02d:%02d:%02d.%03d', CAST(value * 1000 AS BIGINT) // 3600000, CAST(value * 1000 AS BIGINT) // 60000 % 60, CAST(value * 1000 AS BIGINT) // 1000 % 60, CAST(value * 1000 AS BIGINT) % 1000) AS clock FROM events""")
def trace_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as hours, minutes, seconds and milliseconds."""
    ticks = F.round(F.col("value") * 1000).cast("long") * 10_000
    return _t(spark, sf_dir, "events").select("event_id", trace.clock(ticks).alias("clock"))


@query("""SELECT event_id, CASE WHEN s < 3600 THEN s // 60 || ' minutes ago' WHEN s < 86400 THEN s // 3600 || ' hours ago' ELSE s // 86400 || ' days ago' END AS age
FROM (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS s FROM events)""")
def commit_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages in words."""
    return _t(spark, sf_dir, "events").select("event_id", vcs.age(F.round(F.col("value") * 1000).cast("long")).alias("age"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS path, max_by(CAST(l_partkey AS VARCHAR), (l_linenumber, l_partkey)) AS value FROM lineitem GROUP BY 1")
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the highest layer wins."""
    rows = _t(spark, sf_dir, "lineitem").select(F.struct("l_linenumber", "l_partkey").alias("layer"), F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").cast("string").alias("value"))
    return overlay.layered(rows)


@query("""WITH o AS (SELECT o_custkey AS key, o_orderkey AS row_id, o_orderstatus AS status FROM orders)
SELECT key, row_id FROM o WHERE status = 'F' AND key NOT IN (SELECT key FROM o WHERE status = 'P') UNION ALL SELECT key, row_id FROM o WHERE status = 'P'""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot whose keys are replaced by a newer one's: customers' finished orders by their pending ones."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    part = lambda status: rows.where(F.col("o_orderstatus") == status).select("key", "row_id")
    return incremental.upserted(part("F"), part("P"), ["key"])


@query("""SELECT o_custkey, min_by(o_orderpriority, (CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey)) AS status FROM orders GROUP BY 1""")
def merged_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first provider's status of each path."""
    rank = F.struct(F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), "o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("status"), rank.alias("provider_rank"))
    return vcs.merged(rows).select(F.col("path").alias("o_custkey"), "status")


@query("""SELECT l_orderkey, CAST(round(100 * sum(l_linenumber * least(l_quantity / 40, 1)) / sum(l_linenumber)) AS DOUBLE) AS percent FROM lineitem GROUP BY 1""")
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted progress of each key's phases."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("weight"), F.col("l_quantity").alias("done"), F.lit(40.0).alias("total"))
    return status.progress(rows, ["l_orderkey"])


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'busy' WHEN bool_or(o_orderstatus = 'O') THEN 'updating' ELSE 'idle' END AS state FROM orders GROUP BY 1""")
def service_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most urgent state of each key."""
    name = F.when(F.col("o_orderstatus") == "P", "busy").when(F.col("o_orderstatus") == "O", "updating").otherwise("idle")
    return status.state(_t(spark, sf_dir, "orders").select("o_custkey", name.alias("state"), F.lit(1).alias("n")), ["o_custkey"])


def _scope_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as modules: brands own them, sizes place them, and each depends on two others; two brands are the game and the engine."""
    part, key = _t(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["Runtime", "Developer", "Editor", "UncookedOnly", "Program"])), (key % 5 + 1).cast("int"))
    name = lambda c: F.concat(F.lit("m"), c)
    deps = F.array(name((key * 2 + 1).cast("string")), name((key + 7).cast("string")))
    modules = part.select(name(key.cast("string")).alias("name"), kind.alias("type"), F.col("p_brand").alias("owner"), F.concat(F.lit("/S"), "p_size", F.lit("/m"), key).alias("root_path"), deps.alias("deep_dependencies"))
    components = spark.createDataFrame([("Brand#11", "Game", "/S7"), ("Brand#12", "Engine", "/s8/"), ("Plug", "Plugin", "/S9")], "name string, type string, root_path string")
    return modules, components


_SCOPED = """WITH m AS (SELECT p_partkey AS k, 'm' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN 'Runtime' WHEN 1 THEN 'Developer' WHEN 2 THEN 'Editor' WHEN 3 THEN 'UncookedOnly' ELSE 'Program' END AS type,
  p_brand AS owner, p_size AS size FROM part),
s AS (SELECT 'game' AS scope, k, name FROM m WHERE owner = 'Brand#11' OR size = 7 UNION ALL SELECT 'engine', k, name FROM m WHERE owner = 'Brand#12' OR size = 8
UNION ALL SELECT 'runtime', k, name FROM m WHERE owner = 'Brand#11' OR type = 'Runtime' UNION ALL SELECT 'editor', k, name FROM m WHERE type <> 'Program' UNION ALL SELECT 'full', k, name FROM m WHERE type <> 'Program')"""


@query(f"{_SCOPED} SELECT scope, name FROM s UNION SELECT scope, 'm' || (k * 2 + 1) FROM s UNION SELECT scope, 'm' || (k + 7) FROM s")
def project_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules of each scope with all that they depend on."""
    modules, components = _scope_tables(spark, sf_dir)
    parts = [project.scoped(modules, components, s).select(F.lit(s).alias("scope"), "name") for s in project.SCOPES]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT 'm' || p_partkey AS name, CASE p_partkey % 5 WHEN 0 THEN 'runtime' WHEN 1 THEN 'developer' WHEN 4 THEN 'program' ELSE 'editor' END AS bucket FROM part""")
def module_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every module."""
    modules, _ = _scope_tables(spark, sf_dir)
    return modules.select("name", project.bucket(F.col("type")).alias("bucket"))


_TREE = """WITH d AS (SELECT r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name AS path, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
k AS (SELECT r_name || '/' || n_name AS root, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 = 0
UNION ALL SELECT r_name, s_name || 'Long' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 7 = 0 AND r_regionkey < 3)"""


@query(f"""{_TREE}, h AS (SELECT path, root, name FROM d JOIN k ON starts_with(path, root || '/')),
b AS (SELECT path, max_by(root, length(root)) AS root FROM h GROUP BY path)
SELECT path, b.root, min_by(name, (-length(name), name)) AS name FROM b JOIN k ON k.root = b.root GROUP BY ALL""")
def nearest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest folder above each path with a marker file, and the longest of its markers."""
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    starts = _t(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("path"))
    own = _t(spark, sf_dir, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    listed = own.where("s_suppkey % 3 = 0").select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "s_name", F.lit(".uproject")).alias("path"))
    listed = listed.union(own.where("s_suppkey % 7 = 0 and r_regionkey < 3").select(F.concat("r_name", F.lit("/"), "s_name", F.lit("Long.uproject"))))
    return finders.projects(starts, listed, "longest").select("path", "root", "name")


@query("""WITH x AS (SELECT 'p' || (user_id % 3) AS platform, 's' || (user_id % 4) AS section, 'k' || (event_id % 10) AS key, CASE event_type WHEN 'error' THEN '!' WHEN 'click' THEN '' ELSE '+' END AS op,
  CAST(event_id % 7 AS VARCHAR) AS value, event_id AS line FROM events),
r AS (SELECT platform, section, key, max(line) FILTER (WHERE op <> '+') AS reset, count(*) AS steps FROM x GROUP BY ALL),
v AS (SELECT r.*, count(x.line) AS n, max_by(x.value, x.line) AS last FROM r LEFT JOIN x ON x.platform = r.platform AND x.section = r.section AND x.key = r.key
  AND ((x.op = '+' AND (reset IS NULL OR x.line > reset)) OR (x.op = '' AND x.line = reset)) GROUP BY ALL)
SELECT platform, section, key, CASE n WHEN 0 THEN 'nil' WHEN 1 THEN last ELSE '[Array x' || n || '] ' || last END AS value, steps FROM v""")
def config_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested configuration: platforms, sections and parameters, with each parameter's displayed value and the number of lines that made it."""
    kind, name = F.col("event_type"), lambda letter, c: F.concat(F.lit(letter), c)
    op = F.when(kind == "error", "!").when(kind == "click", "").otherwise("+")
    lines = _t(spark, sf_dir, "events").select(
        name("p", F.col("user_id") % 3).alias("platform"), F.lit(1).alias("stack_rank"), F.lit("a.ini").alias("file"), name("s", F.col("user_id") % 4).alias("section"),
        name("k", F.col("event_id") % 10).alias("key"), op.alias("op"), (F.col("event_id") % 7).cast("string").alias("value"), F.col("event_id").alias("line"),
    )
    sections = overlay.nested(lines).select(F.col("name").alias("platform"), F.explode("sections").alias("s")).select("platform", F.col("s.name").alias("section"), F.explode("s.parameters").alias("p"))
    return sections.select("platform", "section", "p.key", "p.value", F.size("p.history").cast("long").alias("steps"))


@query(r"""WITH f AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages WHERE page_id % 2 = 0),
x AS (SELECT path, split_part(path, '/', 1) AS folder, regexp_replace(path, '^[^/]*/', '') AS inner_ FROM f WHERE contains(path, '/'))
SELECT DISTINCT folder AS platform FROM x WHERE starts_with(inner_, 'en/') OR starts_with(inner_, 'de/') OR folder IN ('Windows', 'Linux')""")
def platform_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms by the markers in their folders: hosts as folders, a language folder as the marker."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    marker = F.regexp_replace(path, "^([^/]+)/(en|de)/", "$1/Config/")
    return config_files.platforms(_t(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.concat(F.lit("/p/Platforms/"), marker).alias("path")), "/p")
