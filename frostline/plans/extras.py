"""Further registered queries, each beside its SQL: files written and read back, column functions, checks, archives.

A query over files writes part of the study's tables in a fresh folder, reads it with the strict reader and returns what
the reader finds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import core
from ..operators import archive, explain, fusion, quantiles, rank, validate
from ..sources import readers, sinks
from . import oracle
from .queries import QUERIES, pair_rows, r6, union
from .relations import Study

SQL: dict[str, str] = {}


def query(sql: str, *more: str, plain: bool = False) -> Callable:
    """Registers a query over a Study beside its SQL, which may use the study's relations and some more."""

    def add(f: Callable[[Study], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Study(spark, sf_dir))
        SQL[f.__name__] = sql if plain else oracle.with_(sql, *more)
        return f

    return add


# --- files ---------------------------------------------------------------------------------------


@query("SELECT uid, item, ts_ms FROM inter")
def interactions_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "interactions")
    sinks.gzip_csv(s.interactions.select(F.col("uid").alias("user"), "item", F.col("ts_ms").alias("timestamp")), path)
    return readers.interactions(s.spark, path)


@query("SELECT DISTINCT uid, item FROM vrows")
def positives_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "positives")
    sinks.gzip_csv(s.dev.cold_rows.select(F.col("uid").alias("user"), "item", F.col("ts_ms").alias("timestamp")), path)
    return readers.positives(s.spark, path)


@query("SELECT uid, string_agg(item, ' ' ORDER BY event_id) items FROM inter GROUP BY uid")
def sequences_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "sequences")
    ordered = s.interactions.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("event_id", "item"))).alias("e"))
    ordered.select(F.concat_ws("\t", F.col("uid").cast("string"), F.array_join(F.transform("e", lambda x: x["item"].cast("string")), " "))).write.text(path)
    return readers.sequences(s.spark, path).select("uid", F.array_join("items", " ").alias("items"))


@query("SELECT item, md5(title) title FROM titles")
def titles_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "titles")
    s.titles.write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(path)
    return readers.titles(s.spark, path).select("item", F.md5(F.col("title").cast("binary")).alias("title"))


ENGAGED = "engaged AS (SELECT item, count(*) likes, count(DISTINCT uid) AS \"views\" FROM inter GROUP BY item)"


def engagement(s: Study) -> DataFrame:
    """Events count as likes and users as views, written and read as engagement is."""
    path = sinks.scratch(s.spark, "engagement")
    s.interactions.groupBy("item").agg(F.count("*").alias("likes"), F.countDistinct("uid").alias("views")).write.option("sep", "\t").csv(path)
    return readers.engagement(s.spark, path)


@query('SELECT item, likes, "views" FROM engaged', ENGAGED)
def engagement_file(s: Study) -> DataFrame:
    return engagement(s)


@query(
    """SELECT (SELECT count(*) FROM engaged) items, (SELECT sum(likes)::BIGINT FROM engaged) likes, (SELECT count(*) FROM (SELECT DISTINCT item FROM inter) WHERE item NOT IN (SELECT item FROM engaged)) without_engagement,
    (SELECT count(*) FROM engaged WHERE item NOT IN (SELECT item FROM titles)) without_title, (SELECT max(likes) FROM engaged) most_likes""",
    ENGAGED,
)
def engagement_coverage(s: Study) -> DataFrame:
    found = s.kept(engagement(s))
    both = validate.set_differences(s.interactions.select("item"), found, "item").select(F.col("only_a").alias("without_engagement"))
    titled = validate.set_differences(found, s.titles, "item").select(F.col("only_a").alias("without_title"))
    return found.agg(F.count("*").alias("items"), F.sum("likes").alias("likes"), F.max("likes").alias("most_likes")).crossJoin(both).crossJoin(titled)  # single rows


@query("SELECT CASE WHEN likes <= 5 THEN '1-5' WHEN likes <= 10 THEN '6-10' ELSE '11+' END segment, count(*) items, sum(likes)::BIGINT likes FROM engaged GROUP BY 1", ENGAGED)
def engagement_segments(s: Study) -> DataFrame:
    segment = F.when(F.col("likes") <= 5, "1-5").when(F.col("likes") <= 10, "6-10").otherwise("11+")
    return engagement(s).groupBy(segment.alias("segment")).agg(F.count("*").alias("items"), F.sum("likes").alias("likes"))


@query("SELECT item FROM vcold")
def items_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "items")
    sinks.gzip_csv(s.dev.cold_items, path, "item")
    return readers.items(s.spark, path)


UNIT = "units AS (SELECT item, pos, CASE WHEN z = 0 THEN 0 ELSE x / z END x, z FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY item)) z FROM emb))"


def units(s: Study) -> DataFrame:
    """(item, embedding): vectors of unit length; zero vectors go."""
    v = F.col("embedding").cast("array<double>")
    rows = s.features.select("item", v.alias("v"), core.norm(v).alias("z")).where("z > 0")
    return rows.select("item", F.transform("v", lambda x: (x / F.col("z")).cast("float")).alias("embedding"))


@query("SELECT item, CAST(pos AS INT) pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) + 0e0 x FROM units WHERE z > 0", UNIT)
def features_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "features")
    sinks.features(units(s), path)
    return readers.features(s.spark, path).select("item", F.posexplode("embedding").alias("pos", "x")).select("item", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT item, count(*) numbers, round(sum(x), 4) + 0e0 total FROM units WHERE z > 0 GROUP BY item", UNIT)
def vector_lines(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "vectors")
    sinks.vector_csv(units(s), path)
    parts = s.spark.read.text(path).select(F.split("value", ",").alias("p"))
    numbers = F.transform(F.slice("p", 2, 10_000), lambda x: x.cast("double"))
    return parts.select(F.get("p", F.lit(0)).cast("long").alias("item"), F.size(numbers).cast("long").alias("numbers"), F.round(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT item, h FROM (SELECT item, CASE WHEN h >= 9223372036854775808::HUGEINT THEN (h - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END h FROM bits)")
def hashes_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "hashes")
    sinks.hash_csv(s.hashes, path)
    return readers.hashes(s.spark, path)


CELLS = 12
GRIDS = f"grids AS (SELECT item, pos, x - avg(x) OVER (PARTITION BY item) x FROM emb WHERE pos < {CELLS})"


@query("SELECT item, CAST(pos AS INT) pos, round(CASE WHEN z = 0 THEN 0 ELSE x / z END, 6) + 0e0 x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY item)) z FROM grids)", GRIDS)
def centred_grid(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "grid")
    rows = s.features.select("item", F.transform(F.slice("embedding", 1, CELLS), lambda x: x.cast("double")).alias("values"))
    sinks.grid_csv(rows, path, CELLS)
    found = readers.grid(s.spark, path, CELLS)
    return found.select("item", F.posexplode(core.centred(F.col("values"))).alias("pos", "x")).select("item", "pos", r6("x"))


@query("SELECT uid, neg_item, round(pos_text, 6) pos_text, round(neg_visual, 6) + 0e0 neg_visual, is_calibration FROM pairs", *oracle.PAIRS)
def pairs_file(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "pairs")
    found = s.kept(pair_rows(s))
    sinks.pair_set(found, path, found.agg(F.count("*").alias("pairs")))
    return readers.pairs(s.spark, f"{path}/pairs").select("uid", "neg_item", r6("pos_text"), r6("neg_visual"), "is_calibration")


@query("SELECT (SELECT count(*) FROM pairs) stated, (SELECT count(DISTINCT uid) FROM pairs) users", *oracle.PAIRS)
def pairs_about(s: Study) -> DataFrame:
    path = sinks.scratch(s.spark, "pairs")
    found = s.kept(pair_rows(s))
    sinks.pair_set(found, path, found.agg(F.count("*").alias("stated"), F.countDistinct("uid").alias("users")))
    return readers.payload(s.spark, f"{path}/about", "stated long, users long")


LINES = (
    "outs AS ("
    + " UNION ALL ".join(f"SELECT '{p}_{k}' part, concat_ws(',', {c}) line FROM {t}" for p, names in (("validation", ("dev", "vcold", "vrows", "vwarm")), ("test", ("fin", "tcold", "trows", "twarm"))) for k, t, c in zip(("train", "cold_items", "cold_rows", "warm_rows"), names, ("uid, item, ts_ms", "item", "uid, item, ts_ms", "uid, item, ts_ms"), strict=True))
    + " UNION ALL SELECT 'interactions', concat_ws(',', uid, item, ts_ms) FROM inter UNION ALL SELECT 'cutoffs', concat_ws(',', c1, c2) FROM cuts)"
)


@query("SELECT part, count(*) AS \"rows\", sum(strlen(line) + 1)::BIGINT bytes, sum(CAST('0x' || substr(md5(line), 1, 8) AS BIGINT))::BIGINT checksum FROM outs GROUP BY part", LINES)
def split_manifest(s: Study) -> DataFrame:
    """The ten outputs of the split, as they would be written."""
    row = ("uid", "item", "ts_ms")
    parts = {f"{n}_{k}": (getattr(p, k).select("item") if k == "cold_items" else getattr(p, k).select(*row)) for n, p in (("validation", s.dev), ("test", s.final)) for k in ("train", "cold_items", "cold_rows", "warm_rows")}
    dev, last = s.cuts
    return sinks.manifest(parts | {"interactions": s.interactions.select(*row), "cutoffs": s.spark.createDataFrame([(dev, last)], "dev long, final long")})


@query(f"SELECT uid, u.history.n n, u.history.last_item last_item, u.best.item item FROM (SELECT uid, {{'n': n, 'last_item': last_item}} history, {{'item': best}} best FROM (SELECT h.uid, count(*) n, arg_max(h.item, event_id) last_item, any_value(r.item) best FROM hist h JOIN trk r ON r.uid = h.uid AND r.rank = 1 GROUP BY h.uid)) u")
def demo_payload(s: Study) -> DataFrame:
    """Nested objects of a user's history and first recommendation, written as JSON and read again."""
    path = sinks.scratch(s.spark, "demo")
    past = s.split.train.groupBy("uid").agg(F.struct(F.count("*").alias("n"), F.max_by("item", "event_id").alias("last_item")).alias("history")).join(s.users, "uid", "left_semi")
    best = s.text_ranks.where("rank = 1").select("uid", F.struct("item").alias("best"))
    sinks.demo(past.join(best, "uid"), path)
    found = readers.payload(s.spark, path, "uid long, history struct<n: long, last_item: long>, best struct<item: long>")
    return found.select("uid", F.col("history.n").alias("n"), F.col("history.last_item").alias("last_item"), F.col("best.item").alias("item"))


# --- column functions ----------------------------------------------------------------------------


@query("SELECT uid, count(*) history, CASE WHEN count(*) >= 4 THEN 'standard' ELSE 'caution' END policy FROM hist GROUP BY uid")
def history_policy(s: Study) -> DataFrame:
    return s.history_sizes.select("uid", F.col("n").alias("history"), core.policy(F.col("n")).alias("policy"))


@query("SELECT uid, strftime(make_timestamp(min(ts_ms) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' first_seen, strftime(make_timestamp(max(ts_ms) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' last_seen FROM inter GROUP BY uid")
def user_period(s: Study) -> DataFrame:
    return s.interactions.groupBy("uid").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).select("uid", core.iso_utc(F.col("a")).alias("first_seen"), core.iso_utc(F.col("b")).alias("last_seen"))


@query("SELECT doc_id, CASE WHEN length(c) > 180 THEN concat(rtrim(substr(c, 1, 179)), '…') ELSE c END title FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) c FROM documents)", plain=True)
def shortened_titles(s: Study) -> DataFrame:
    return s.table("documents").select("doc_id", core.shortened("text").alias("title"))


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) n FROM documents", plain=True)
def stripped_lengths(s: Study) -> DataFrame:
    return s.table("documents").select("doc_id", F.length(core.stripped("text")).cast("long").alias("n"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) escaped FROM documents", plain=True)
def escaped_titles(s: Study) -> DataFrame:
    return s.table("documents").select("doc_id", F.md5(core.xml_escaped(F.col("text")).cast("binary")).alias("escaped"))


@query("SELECT lang, count(*) documents, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) non_ascii FROM documents GROUP BY lang", plain=True)
def non_ascii_titles(s: Study) -> DataFrame:
    return s.table("documents").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(core.has_non_ascii(F.col("text"))).alias("non_ascii"))


@query("SELECT item, CAST(pos AS INT) pos, round(CASE WHEN z = 0 THEN 0 ELSE x / z END, 6) + 0e0 x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY item)) z FROM (SELECT item, pos, x - avg(x) OVER (PARTITION BY item) x FROM emb))")
def centred_vectors(s: Study) -> DataFrame:
    return s.features.select("item", F.posexplode(core.centred(F.col("embedding"))).alias("pos", "x")).select("item", "pos", r6("x"))


@query(f"SELECT 'recall' metric, printf('%.1f%%', recall * 100) shown, round(recall, 6) total FROM ({oracle.metrics_of('trk')}) WHERE k = 10 UNION ALL SELECT 'hit_rate', printf('%.1f%%', hit_rate * 100), round(hit_rate, 6) FROM ({oracle.metrics_of('trk')}) WHERE k = 10")
def demo_totals(s: Study) -> DataFrame:
    """The totals that the demo shows, as percentages too."""
    m = rank.metrics(s.text_ranks, s.positives, (10,))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("total")) for c in ("recall", "hit_rate")]))
    return m.select(each.alias("m")).select("m.metric", core.percent(F.col("m.total")).alias("shown"), F.round("m.total", 6).alias("total"))


# --- checks and sets -----------------------------------------------------------------------------


@query("SELECT 'documents' AS \"table\", count(*) - count(DISTINCT doc_id) repeated FROM documents UNION ALL SELECT 'embeddings', count(*) - count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'pages', count(*) - count(DISTINCT page_id) FROM pages", plain=True)
def repeated_ids(s: Study) -> DataFrame:
    return union(s.table(t).agg(F.lit(t).alias("table"), (F.count("*") - F.countDistinct(k)).alias("repeated")) for t, k in (("documents", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id")))


@query("SELECT count(*) AS \"rows\", count(*) - count(DISTINCT item) repeated, 0::BIGINT not_finite, count(*) FILTER (abs(z - 1) > 1e-6) not_unit FROM (SELECT item, any_value(z) z FROM units GROUP BY item)", UNIT)
def vector_checks(s: Study) -> DataFrame:
    return validate.vector_faults(s.features)


@query(
    "SELECT endpoint, count(*) FILTER (abs(a - b) > 1e-12) differences FROM (" + " UNION ALL ".join(f"SELECT '{n}' endpoint, unnest([g.recall, g.ndcg, g.hit_rate]) a, unnest([m.recall, m.ndcg, m.hit_rate]) b FROM grid g, ({oracle.metrics_of(r)}) m WHERE g.weight = {w} AND m.k = 10" for n, r, w in (("text", "trk", 1.0), ("visual", "vrk", 0.0))) + ") GROUP BY endpoint",
    oracle.FUSED, oracle.GRID,
)
def fusion_endpoints(s: Study) -> DataFrame:
    """How many metrics of fusion with all weight on one side differ from those of that side alone."""
    by_text, by_look, fused = s.ranks("text", "visual", "fused", top=10)
    grid = s.kept(fusion.fusion_grid(fused, s.positives))
    sides = (("text", by_text, 1.0), ("visual", by_look, 0.0))
    names = ("recall", "ndcg", "hit_rate")
    found = [(n, grid.where(F.col("weight") == w).select(F.lit(10).alias("k"), *names), rank.metrics(r, s.positives, (10,)).select("k", *names)) for n, r, w in sides]
    return union(validate.endpoint_differences(a, b, ["k"]).agg(F.lit(n).alias("endpoint"), F.count("*").alias("differences")) for n, a, b in found)


@query("SELECT split, parts, total, parts = total AS whole FROM (SELECT 'validation' split, (SELECT count(*) FROM dev) + (SELECT count(*) FROM vwin) + (SELECT count(*) FROM twin) parts UNION ALL SELECT 'test', (SELECT count(*) FROM fin) + (SELECT count(*) FROM twin)), (SELECT count(*) total FROM inter)")
def frozen_counts(s: Study) -> DataFrame:
    """Rows of histories and windows against all rows; a difference raises."""
    total = s.interactions.count()
    sizes = {"validation": s.dev.train.count() + s.dev.window.count() + s.final.window.count(), "test": s.final.train.count() + s.final.window.count()}
    validate.expect_counts(s.interactions, rows=sizes["validation"])
    validate.expect_counts(s.interactions, rows=sizes["test"])
    return s.spark.createDataFrame([(k, n, total, n == total) for k, n in sizes.items()], "split string, parts long, total long, whole boolean")


@query("SELECT item FROM trainitems UNION SELECT item FROM cand")
def ranked_universe(s: Study) -> DataFrame:
    """All items whose vectors a ranking needs."""
    return s.train_items.union(s.candidates).distinct()


@query("SELECT uid FROM (SELECT uid, max(score) best FROM tsc GROUP BY uid) WHERE best = 0 ORDER BY uid LIMIT 5")
def case_all_zero(s: Study) -> DataFrame:
    """The report's first five users whom no candidate shares a term with."""
    return s.text_scores.groupBy("uid").agg(F.max("score").alias("best")).where("best = 0").orderBy("uid").limit(5).select("uid")


@query("SELECT 'words' search, doc_id FROM documents WHERE contains(lower(text), 'the') UNION ALL SELECT 'topic', doc_id FROM documents WHERE lang = 'de'", plain=True)
def history_search(s: Study) -> DataFrame:
    catalog = s.table("documents").select("doc_id", F.col("text").alias("title"), F.col("lang").alias("topic"))
    return union(explain.search(catalog, words, topic).select(F.lit(n).alias("search"), "doc_id") for n, words, topic in (("words", " The ", "de"), ("topic", "  ", "de")))


# --- archives ------------------------------------------------------------------------------------

ARCHIVE = "imgs AS (SELECT doc_id item, strlen(text) size, strlen(text) // 2 packed, text, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 640 + 1 END w, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 480 + 1 END h FROM documents)"


def images(s: Study) -> DataFrame:
    """Documents as members of an archive: a JPEG header of made-up dimensions before each text, none for every seventh."""
    docs = s.table("documents")
    four = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    head = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), four(F.col("doc_id") % 480 + 1), four(F.col("n_chars") % 640 + 1), F.lit("03"))
    body = F.coalesce("text", F.lit("")).cast("binary")
    name = F.concat(F.lit("covers/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".JPG").otherwise(".jpg"))
    return docs.select(F.col("doc_id").alias("item"), name.alias("name"), F.octet_length("text").cast("long").alias("size"), F.floor(F.octet_length("text") / 2).cast("long").alias("packed"), F.crc32(body).alias("crc"), F.when(F.col("doc_id") % 7 == 0, body).otherwise(F.concat(F.unhex(head), body)).alias("content"))


@query("SELECT count(*) members, sum(size)::BIGINT bytes, sum(packed)::BIGINT packed, round(sum(packed) / sum(size), 6) ratio, count(*) FILTER (w IS NULL) unreadable, count(*) FILTER (h > w) portrait, count(*) FILTER (h < w) landscape, count(*) FILTER (h = w) square FROM imgs", ARCHIVE)
def archive_stats(s: Study) -> DataFrame:
    return archive.stats(images(s))


@query("SELECT width, height, n FROM (SELECT CAST(w AS INT) width, CAST(h AS INT) height, count(*) n FROM imgs WHERE w IS NOT NULL GROUP BY ALL) ORDER BY n DESC, width, height LIMIT 20", ARCHIVE)
def archive_common_sizes(s: Study) -> DataFrame:
    return archive.common_sizes(images(s))


@query("SELECT 'jpg' extension, count(*) n FROM imgs", ARCHIVE)
def archive_extensions(s: Study) -> DataFrame:
    return archive.extensions(images(s))


@query("SELECT count(*) FILTER (n > 1) groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT members FROM (SELECT count(*) n FROM imgs GROUP BY text, w, h)", ARCHIVE)
def archive_duplicates(s: Study) -> DataFrame:
    return archive.duplicates(images(s)).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


@query("SELECT item, CAST(coalesce(w, -1) AS INT) width, CAST(coalesce(h, -1) AS INT) height FROM imgs", ARCHIVE)
def jpeg_header_dims(s: Study) -> DataFrame:
    """(item, width, height), -1 where there is no readable header."""
    from ..functions.jpeg import jpeg_dimensions

    return images(s).select("item", jpeg_dimensions("content").alias("d")).select("item", *[F.coalesce(f"d.{c}", F.lit(-1)).alias(c) for c in ("width", "height")])


@query("SELECT item, 'jpg' suffix, NOT (item % 3 = 0) AS lower FROM imgs", ARCHIVE)
def member_names(s: Study) -> DataFrame:
    """Members' items and suffixes from their names; an unsafe name is an error."""
    return archive.names(images(s)).select("item", "suffix", (~F.contains("name", F.lit(".JPG"))).alias("lower"))


@query("SELECT item, sha256(concat('file:', item, chr(10))) digest FROM cand")
def file_digests(s: Study) -> DataFrame:
    """Digests of whole files, one for each candidate."""
    path = sinks.scratch(s.spark, "files")
    s.candidates.select(F.concat(F.lit("file:"), F.col("item").cast("string")).alias("line"), F.col("item").alias("of")).write.partitionBy("of").text(path)
    return archive.digests(s.spark, f"{path}/of=*/*.txt").select(F.regexp_extract("path", r"of=(\d+)", 1).cast("long").alias("item"), "digest")
