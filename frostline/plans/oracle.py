"""The registered queries as DuckDB SQL over the given tables, written apart from the DataFrame plans.

Adding 0e0 turns a negative zero into zero, as rounding does in Spark.
"""

from __future__ import annotations

from ..config import PROTOCOL

SEED = PROTOCOL.seed
W = PROTOCOL.learned

RELATIONS = f"""
ne AS (SELECT count(*) n FROM events),
nv AS (SELECT least((SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings)) n),
placed AS (SELECT user_id uid, event_id, epoch_us(ts) // 1000 ts_ms, event_id * nv.n // ne.n base FROM events, ne, nv),
inter AS (SELECT uid, CASE WHEN event_id % 3 = 0 THEN (event_id * 7919) % (base + 1) ELSE base END item, ts_ms, event_id FROM placed),
titles AS (SELECT doc_id item, text title FROM documents WHERE doc_id IN (SELECT item FROM inter)),
ordered AS (SELECT ts_ms, row_number() OVER (ORDER BY ts_ms) - 1 rn, count(*) OVER () n FROM inter),
cuts AS (SELECT max(ts_ms) FILTER (rn = CAST(round_even((n - 1) * 0.8, 0) AS BIGINT)) c1, max(ts_ms) FILTER (rn = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT)) c2 FROM ordered),
dev AS (SELECT inter.* FROM inter, cuts WHERE ts_ms < c1),
fin AS (SELECT inter.* FROM inter, cuts WHERE ts_ms < c2),
vwin AS (SELECT inter.* FROM inter, cuts WHERE ts_ms >= c1 AND ts_ms < c2),
twin AS (SELECT inter.* FROM inter, cuts WHERE ts_ms >= c2),
vcold AS (SELECT DISTINCT item FROM vwin WHERE item NOT IN (SELECT item FROM dev)),
tcold AS (SELECT DISTINCT item FROM twin WHERE item NOT IN (SELECT item FROM fin)),
vrows AS (SELECT * FROM vwin WHERE item IN (SELECT item FROM vcold) AND uid IN (SELECT uid FROM dev)),
trows AS (SELECT * FROM twin WHERE item IN (SELECT item FROM tcold) AND uid IN (SELECT uid FROM fin)),
vwarm AS (SELECT * FROM vwin WHERE item IN (SELECT item FROM dev) AND uid IN (SELECT uid FROM dev)),
twarm AS (SELECT * FROM twin WHERE item IN (SELECT item FROM fin) AND uid IN (SELECT uid FROM fin)),
pos AS (SELECT DISTINCT uid, item FROM vrows),
usr AS (SELECT DISTINCT uid FROM pos),
cand AS (SELECT item FROM vcold),
hist AS (SELECT * FROM dev WHERE uid IN (SELECT uid FROM usr)),
tok AS (SELECT item, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) term FROM titles),
tf AS (SELECT item, term, count(*) tf FROM tok GROUP BY ALL),
trainitems AS (SELECT DISTINCT item FROM dev),
ntrain AS (SELECT CAST(count(*) AS DOUBLE) n FROM trainitems),
dfs AS (SELECT term, count(*) df FROM tf JOIN trainitems USING (item) GROUP BY term),
idfs AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 idf FROM dfs, ntrain WHERE df >= 2),
raw AS (SELECT item, term, (1 + ln(tf)) * idf w FROM tf JOIN idfs USING (term)),
vec AS (SELECT item, term, w / sqrt(sum(w * w) OVER (PARTITION BY item)) w FROM raw),
summed AS (SELECT uid, term, sum(w) w FROM hist JOIN vec USING (item) GROUP BY ALL),
prof AS (SELECT uid, term, w / sqrt(sum(w * w) OVER (PARTITION BY uid)) w FROM summed),
tdot AS (SELECT p.uid, v.item, sum(p.w * v.w) s FROM prof p JOIN vec v USING (term) WHERE v.item IN (SELECT item FROM cand) GROUP BY ALL),
tsc AS (SELECT uid, item, round(coalesce(s, 0), 9) score FROM usr CROSS JOIN cand LEFT JOIN tdot USING (uid, item)),
trk AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, md5(concat('{SEED}:', uid, ':', item)), item) rank FROM tsc),
emb AS (SELECT vec_id item, generate_subscripts(embedding, 1) - 1 pos, CAST(unnest(embedding) AS DOUBLE) x FROM embeddings),
dsum AS (SELECT uid, pos, sum(x) x FROM hist JOIN emb USING (item) GROUP BY ALL),
dprof AS (SELECT uid, pos, CASE WHEN size = 0 THEN 0 ELSE x / size END x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY uid)) size FROM dsum)),
vsc AS (SELECT d.uid, e.item, round(sum(d.x * e.x), 9) score FROM dprof d JOIN emb e USING (pos) WHERE e.item IN (SELECT item FROM cand) GROUP BY ALL),
vrk AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, md5(concat('{SEED}:', uid, ':', item)), item) rank FROM vsc),
ks AS (SELECT unnest([5, 10, 20, 50]) k),
gains AS (SELECT i, 1 / log2(i + 1) g FROM range(1, 51) r(i)),
ideals AS (SELECT i n, sum(g) OVER (ORDER BY i) ideal FROM gains),
buckets AS (SELECT uid, CASE WHEN count(*) <= 3 THEN '1-3' WHEN count(*) <= 6 THEN '4-6' WHEN count(*) <= 10 THEN '7-10' ELSE '11+' END bucket FROM hist GROUP BY uid),
acts AS (SELECT 'user' entity, uid id, count(*) n FROM inter GROUP BY uid UNION ALL SELECT 'item', item, count(*) FROM inter GROUP BY item),
acto AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n, id) i, count(*) OVER (PARTITION BY entity) m, sum(n) OVER (PARTITION BY entity) t FROM acts),
names AS (SELECT item, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') t, regexp_extract_all(lower(title), '[a-z0-9]+') toks FROM titles),
bits AS (SELECT item, sum(CASE WHEN x > 0 THEN 1::HUGEINT << (63 - pos)::INT ELSE 0 END) h FROM emb WHERE pos < 64 GROUP BY item)
"""


def users_of(ranks: str, positives: str = "pos", ks: str = "ks", extra: str = "") -> str:
    """A query of per-user metrics: uid, k, recall, ndcg, hit."""
    x, on = (f", {extra}", f" AND r.{extra} = g.{extra}") if extra else ("", "")
    grid = f" CROSS JOIN (SELECT DISTINCT {extra} FROM {ranks}) g" if extra else ""
    gx = f", g.{extra}" if extra else ""
    return f"""SELECT uid{x}, k, hits / t recall, dcg / ideal ndcg, CAST(hits > 0 AS DOUBLE) hit FROM (
      SELECT n.uid{gx}, k, t, count(r.item) hits, coalesce(sum(1 / log2(r.rank + 1)), 0) dcg
      FROM (SELECT uid, count(*) t FROM {positives} GROUP BY uid) n CROSS JOIN {ks}{grid}
      LEFT JOIN (SELECT q.* FROM {ranks} q JOIN {positives} p ON p.uid = q.uid AND p.item = q.item) r ON r.uid = n.uid AND r.rank <= k{on}
      GROUP BY n.uid{gx}, k, t) JOIN ideals ON ideals.n = least(t, k)"""


MEANS = "count(*) users, round(avg(recall), 6) recall, round(avg(ndcg), 6) ndcg, round(avg(hit), 6) hit_rate"
TEN = "(SELECT 10 k)"


def metrics_of(ranks: str, positives: str = "pos") -> str:
    return f"SELECT k, {MEANS} FROM ({users_of(ranks, positives)}) GROUP BY k"


def with_(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([RELATIONS.strip(), *more]) + "\n" + body


SUMMARY = """SELECT min(n) AS "min", median(n) AS median, max(n) FILTER (i - 1 = CAST(round_even((m - 1) * 0.9, 0) AS BIGINT)) p90, max(n) AS "max" FROM acto WHERE entity = '{}'"""
HITS = """hits AS (SELECT u.uid, coalesce(t.h, false) t, coalesce(v.h, false) v FROM usr u
  LEFT JOIN (SELECT DISTINCT uid, true h FROM trk JOIN pos USING (uid, item) WHERE rank <= 10) t ON t.uid = u.uid
  LEFT JOIN (SELECT DISTINCT uid, true h FROM vrk JOIN pos USING (uid, item) WHERE rank <= 10) v ON v.uid = u.uid)"""
FUSED = f"""fused AS (SELECT uid, weight, item, row_number() OVER (PARTITION BY uid, weight ORDER BY round(weight * rt + (1 - weight) * rv, 9), md5(concat('{SEED}:', uid, ':', item)), item) rank
  FROM (SELECT t.uid, t.item, t.rank - 1 rt, v.rank - 1 rv FROM trk t JOIN vrk v ON t.uid = v.uid AND t.item = v.item) CROSS JOIN (SELECT CAST(unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) weight))"""
GRID = f"grid AS (SELECT weight, {MEANS} FROM ({users_of('fused', 'pos', TEN, 'weight')}) GROUP BY weight)"
PART = "CASE WHEN CAST('0x' || substr(sha256('gate:' || uid), 1, 2) AS BIGINT) % 2 = 0 THEN 'gate_dev' ELSE 'gate_audit' END"
GATE = (
    f"tops AS (SELECT uid, max(score) top_score, {PART} part FROM tsc GROUP BY uid)",
    f"gt AS ({users_of('trk', 'pos', TEN)})",
    f"gv AS ({users_of('vrk', 'pos', TEN)})",
    "gr AS (SELECT tops.*, gt.recall tr, gt.ndcg tn, gt.hit th, gv.recall vr, gv.ndcg vn, gv.hit vh FROM tops JOIN gt USING (uid) JOIN gv USING (uid))",
    "shares AS (SELECT CAST(unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5]) AS DOUBLE) share)",
    "devo AS (SELECT top_score, row_number() OVER (ORDER BY top_score) - 1 i, count(*) OVER () n FROM tops WHERE part = 'gate_dev')",
    "thr AS (SELECT share, CASE WHEN share > 0 THEN max(top_score) FILTER (i = CAST(floor((n - 1) * share) AS BIGINT)) END threshold FROM devo CROSS JOIN shares GROUP BY share)",
)


def gated(rows: str, settings: str, key: str) -> str:
    use = "coalesce(top_score <= threshold, false)"
    pick = lambda c, n: f"round(avg(CASE WHEN {use} THEN v{c} ELSE t{c} END), 6) {n}"
    return f"SELECT {key}, count(*) users, count(*) FILTER ({use}) visual_users, {pick('r', 'recall')}, {pick('n', 'ndcg')}, {pick('h', 'hit_rate')}, round(count(*) FILTER ({use}) / count(*), 6) visual_share FROM {rows} CROSS JOIN {settings} GROUP BY {key}"


CATEGORY = "CASE WHEN th > 0 AND vh > 0 THEN 'both' WHEN th > 0 THEN 'text_only' WHEN vh > 0 THEN 'visual_only' ELSE 'neither' END"
POLICIES = gated("(SELECT * FROM gr WHERE part = 'gate_audit')", "settings", "policy")
AUDIT = (
    *GATE,
    f"devgrid AS ({gated('(SELECT * FROM gr WHERE part = ' + chr(39) + 'gate_dev' + chr(39) + ')', 'thr', 'share')})",
    "best AS (SELECT share FROM devgrid ORDER BY ndcg DESC, recall DESC, share LIMIT 1)",
    "settings AS (SELECT 'gate' policy, threshold FROM thr WHERE share IN (SELECT share FROM best) UNION ALL SELECT 'text', NULL UNION ALL SELECT 'visual', CAST('inf' AS DOUBLE))",
)

PAIRS = (
    "seqs AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts_ms DESC, item DESC, event_id DESC) back, count(*) OVER (PARTITION BY uid) n FROM dev)",
    "loo AS (SELECT uid, item, ts_ms FROM seqs s WHERE back = 1 AND n >= 2 AND NOT EXISTS (SELECT 1 FROM seqs o WHERE o.uid = s.uid AND o.item = s.item AND o.back > 1))",
    "firsts AS (SELECT item, min(ts_ms) first_ts FROM dev GROUP BY item)",
    "avail AS (SELECT l.uid, l.item, count(f.item) available FROM loo l LEFT JOIN firsts f ON f.first_ts <= l.ts_ms GROUP BY ALL)",
    "places AS (SELECT item, row_number() OVER (ORDER BY first_ts, item) - 1 place FROM firsts)",
    f"draws AS (SELECT uid, d draw, CAST('0x' || substr(md5(concat('{SEED}:', uid, ':', d)), 1, 8) AS BIGINT) % available place FROM avail CROSS JOIN range(0, 64) r(d))",
    "free AS (SELECT uid, p.item neg_item, min(draw) draw FROM draws JOIN places p USING (place) WHERE NOT EXISTS (SELECT 1 FROM dev o WHERE o.uid = draws.uid AND o.item = p.item) GROUP BY ALL)",
    "drawn AS (SELECT uid, neg_item, draw FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY draw) k FROM free) WHERE k <= 5)",
    "short AS (SELECT a.uid, a.ts_ms, (SELECT count(*) FROM drawn d WHERE d.uid = a.uid) got FROM (SELECT uid, any_value(ts_ms) ts_ms FROM loo GROUP BY uid) a)",
    f"spare AS (SELECT s.uid, f.item neg_item, got, row_number() OVER (PARTITION BY s.uid ORDER BY md5(concat('{SEED}:', s.uid, ':', f.item)), f.item) k FROM (SELECT * FROM short WHERE got < 5) s JOIN firsts f ON f.first_ts <= s.ts_ms WHERE NOT EXISTS (SELECT 1 FROM dev o WHERE o.uid = s.uid AND o.item = f.item) AND NOT EXISTS (SELECT 1 FROM drawn d WHERE d.uid = s.uid AND d.neg_item = f.item))",
    "negs AS (SELECT * FROM drawn UNION ALL SELECT uid, neg_item, k + 63 FROM spare WHERE k + got <= 5)",
    "past AS (SELECT s.uid, s.item FROM seqs s JOIN loo USING (uid) WHERE s.back > 1)",
    "psum AS (SELECT uid, term, sum(w) w FROM past JOIN vec USING (item) GROUP BY ALL)",
    "pprof AS (SELECT uid, term, w / sqrt(sum(w * w) OVER (PARTITION BY uid)) w FROM psum)",
    "pdsum AS (SELECT uid, pos, sum(x) x FROM past JOIN emb USING (item) GROUP BY ALL)",
    "pdprof AS (SELECT uid, pos, CASE WHEN z = 0 THEN 0 ELSE x / z END x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY uid)) z FROM pdsum))",
    "asked AS (SELECT uid, item, true tgt FROM loo UNION ALL SELECT uid, neg_item, false FROM negs)",
    "ptext AS (SELECT a.uid, a.item, sum(v.w * p.w) s FROM asked a JOIN vec v USING (item) JOIN pprof p ON p.uid = a.uid AND p.term = v.term GROUP BY ALL)",
    "plook AS (SELECT a.uid, a.item, sum(e.x * p.x) s FROM asked a JOIN emb e USING (item) JOIN pdprof p ON p.uid = a.uid AND p.pos = e.pos GROUP BY ALL)",
    "pf AS (SELECT a.uid, a.item, tgt, coalesce(t.s, 0) tx, l.s vx, coalesce(t.s, 0) * l.s px FROM asked a JOIN plook l USING (uid, item) LEFT JOIN ptext t USING (uid, item))",
    """pairs AS (SELECT n.uid, n.item neg_item, round(p.tx, 9) pos_text, round(p.vx, 9) pos_visual, round(p.px, 9) pos_product, round(n.tx, 9) neg_text, round(n.vx, 9) neg_visual, round(n.px, 9) neg_product,
      CAST('0x' || substr(sha256('calibration:' || n.uid), 1, 2) AS BIGINT) < 26 is_calibration FROM pf n JOIN pf p ON p.uid = n.uid AND p.tgt WHERE NOT n.tgt)""",
    """tall AS (SELECT is_calibration, unnest(['text', 'visual', 'product']) feature, unnest([pos_text, pos_visual, pos_product]) p, unnest([neg_text, neg_visual, neg_product]) n FROM pairs)""",
    "stats AS (SELECT feature, avg(x) mean, stddev_pop(x) std, min(x) low, max(x) high FROM (SELECT feature, p x FROM tall WHERE NOT is_calibration UNION ALL SELECT feature, n FROM tall WHERE NOT is_calibration) GROUP BY feature)",
)
LEARNED = (
    *PAIRS,
    "one AS (SELECT " + ", ".join(f"round(max(mean) FILTER (feature = '{f}'), 6) m{f[0]}, round(max(std) FILTER (feature = '{f}'), 6) s{f[0]}" for f in ("text", "visual", "product")) + " FROM stats)",
    f"lsc AS (SELECT uid, item, round({W[0]}::DOUBLE * (t.score - mt) / st + {W[1]}::DOUBLE * (v.score - mv) / sv + {W[2]}::DOUBLE * (t.score * v.score - mp) / sp, 9) score FROM tsc t JOIN vsc v USING (uid, item), one)",
    f"lrk AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, md5(concat('{SEED}:', uid, ':', item)), item) rank FROM lsc)",
)
SIMILAR = """sims AS (SELECT p.uid, p.item, max(CASE WHEN len(list_distinct(list_concat(a.toks, b.toks))) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a.toks), list_distinct(b.toks))) / len(list_distinct(list_concat(a.toks, b.toks))) END) similarity
  FROM pos p JOIN names a USING (item) JOIN (SELECT DISTINCT uid, item FROM hist) h ON h.uid = p.uid JOIN names b ON b.item = h.item GROUP BY ALL)"""
CASES = (
    "firstp AS (SELECT uid, item best_item, rank best_rank, score best_score FROM (SELECT trk.*, row_number() OVER (PARTITION BY uid ORDER BY rank) o FROM trk JOIN pos USING (uid, item)) WHERE o = 1)",
    "ptitles AS (SELECT DISTINCT uid, t FROM hist JOIN names USING (item))",
    """allcases AS (SELECT f.*, top.item top_item, top.score top_score, EXISTS (SELECT 1 FROM ptitles q WHERE q.uid = f.uid AND q.t = n.t) exact
      FROM firstp f JOIN names n ON n.item = f.best_item JOIN (SELECT * FROM trk WHERE rank = 1) top ON top.uid = f.uid)""",
)


def overlap(a: str, b: str) -> str:
    return f"""SELECT count(*) users, round(avg(c), 6) mean_intersection, round(avg(c / (na + nb - c)), 6) mean_jaccard, count(*) FILTER (c < greatest(na, nb)) changed FROM (
      SELECT u.uid, (SELECT count(*) FROM {a} a WHERE a.uid = u.uid AND rank <= 10) na, (SELECT count(*) FROM {b} b WHERE b.uid = u.uid AND rank <= 10) nb,
      (SELECT count(*) FROM {a} t JOIN {b} v ON t.uid = v.uid AND t.item = v.item WHERE t.uid = u.uid AND t.rank <= 10 AND v.rank <= 10) c FROM usr u)"""


CLEAN = (
    "ccand AS (SELECT item FROM cand WHERE item NOT IN (SELECT item FROM bits WHERE h IN (SELECT h FROM bits WHERE item IN (SELECT item FROM trainitems))))",
    "cpos AS (SELECT * FROM pos WHERE item IN (SELECT item FROM ccand))",
)


def exposure(model: str, ranks: str) -> str:
    return f"""SELECT '{model}' model, max(m) candidates, round(avg(CAST(n > 0 AS DOUBLE)), 6) coverage, max(n) most,
      round(CASE WHEN sum(n) = 0 THEN 0 ELSE 2 * sum(i * n) / (max(m) * sum(n)) - (max(m) + 1) / max(m) END, 6) gini,
      round(sum(n) FILTER (m - i < ceil(m * 1 / 100)) / sum(n), 6) top_1_share, round(sum(n) FILTER (m - i < ceil(m * 10 / 100)) / sum(n), 6) top_10_share
      FROM (SELECT n, row_number() OVER (ORDER BY n, item) i, count(*) OVER () m FROM (SELECT c.item, count(r.uid) n FROM cand c LEFT JOIN {ranks} r ON r.item = c.item AND r.rank <= 10 GROUP BY c.item))"""


TOPIC_ROWS = "topics AS (SELECT * FROM (VALUES ('the', 'the and of'), ('de', 'de la le'), ('und', 'die der und'), ('con', 'que el en')) t(topic, words))"
CATALOG = [TOPIC_ROWS, "elig AS (SELECT DISTINCT topic, item, sha256(concat('catalog:', topic, ':', item)) h FROM vec JOIN (SELECT topic, unnest(string_split(words, ' ')) term FROM topics) USING (term) WHERE item IN (SELECT item FROM trainitems))"]
for _i, _topic in enumerate(("the", "de", "und", "con")):
    _before = "".join(f" AND item NOT IN (SELECT item FROM pick{j})" for j in range(_i))
    CATALOG.append(f"pick{_i} AS (SELECT topic, item, row_number() OVER (ORDER BY h) place FROM elig WHERE topic = '{_topic}'{_before} QUALIFY row_number() OVER (ORDER BY h) <= 10)")
CATALOG.append("catalog AS (" + " UNION ALL ".join(f"SELECT * FROM pick{j}" for j in range(4)) + ")")
SIM = "SELECT query, item, round(sum(q.w * v.w), 9) score FROM {q} q JOIN vec v USING (term) WHERE v.item IN (SELECT item FROM cand) GROUP BY ALL HAVING round(sum(q.w * v.w), 9) > 0"


def checks() -> str:
    rows = []
    for name, train, win, cold, ev, late in (("validation", "dev", "vwin", "vcold", "vrows", "ts_ms < c1 OR ts_ms >= c2"), ("test", "fin", "twin", "tcold", "trows", "ts_ms < c2")):
        cut = "c1" if name == "validation" else "c2"
        rows += [
            f"SELECT '{name}_cold_in_train' AS \"check\", count(*) violations FROM {cold} WHERE item IN (SELECT item FROM {train})",
            f"SELECT '{name}_cold_without_title', count(*) FROM {cold} WHERE item NOT IN (SELECT item FROM titles)",
            f"SELECT '{name}_train_late', count(*) FROM {train}, cuts WHERE ts_ms >= {cut}",
            f"SELECT '{name}_cold_rows_outside_window', count(*) FROM {ev}, cuts WHERE {late}",
            f"SELECT '{name}_cold_rows_without_history', count(*) FROM {ev} WHERE uid NOT IN (SELECT uid FROM {train})",
            f"SELECT '{name}_cold_rows_outside_pool', count(*) FROM {ev} WHERE item NOT IN (SELECT item FROM {cold})",
        ]
    rows.append("SELECT 'dev_train_not_in_final_train', count(*) FROM (SELECT uid, item, ts_ms FROM dev EXCEPT ALL SELECT uid, item, ts_ms FROM fin)")
    return " UNION ALL ".join(rows)


def count_row(name: str, table: str) -> str:
    return f"SELECT '{name}' part, count(*) AS \"rows\", count(DISTINCT uid) users, count(DISTINCT item) items FROM {table}"


def cold_row(name: str, win: str, train: str) -> str:
    return f"SELECT '{name}' split, count(*) AS \"rows\", count(DISTINCT uid) users, count(DISTINCT uid) FILTER (uid IN (SELECT uid FROM dev)) users_with_history, count(DISTINCT item) items FROM {win} WHERE item NOT IN (SELECT item FROM {train})"


def final(sql: str) -> str:
    """The same SQL over the final test split."""
    swaps = (("pos AS (SELECT DISTINCT uid, item FROM vrows)", "trows"), ("cand AS (SELECT item FROM vcold)", "tcold"), ("hist AS (SELECT * FROM dev WHERE", "fin"), ("trainitems AS (SELECT DISTINCT item FROM dev)", "fin"))
    for old, table in swaps:
        new = old
        for word in ("vrows", "vcold", "FROM dev"):
            new = new.replace(word, f"FROM {table}" if word.startswith("FROM") else table)
        assert old in sql
        sql = sql.replace(old, new)
    return sql


def hashes(body: str) -> str:
    near = """near AS (SELECT item, nearest_item, distance FROM (SELECT c.item, t.item nearest_item, bit_count(xor(c.h, t.h)) distance, row_number() OVER (PARTITION BY c.item ORDER BY bit_count(xor(c.h, t.h)), t.item) o
      FROM bits c, bits t WHERE c.item IN (SELECT item FROM cand) AND t.item IN (SELECT item FROM trainitems)) WHERE o = 1)"""
    return with_(body, near)


SQL: dict[str, str] = {
    "interaction_overview": with_('SELECT count(*) AS "rows", count(DISTINCT uid) users, count(DISTINCT item) items, min(ts_ms) ts_min, max(ts_ms) ts_max, count(*) - count(DISTINCT (uid, item)) repeated_pairs FROM inter'),
    "duplicate_pairs": with_("SELECT uid, item, count(*) n FROM inter GROUP BY uid, item HAVING count(*) > 1"),
    "user_activity_summary": with_(SUMMARY.format("user")),
    "item_activity_summary": with_(SUMMARY.format("item")),
    "activity_percentiles": with_("SELECT entity, " + ", ".join(f"max(n) FILTER (i = ceil(m * {p} / 100)) p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM acto GROUP BY entity"),
    "activity_gini": with_("SELECT entity, round(2 * sum(i * n) / (max(m) * max(t)) - (max(m) + 1) / max(m), 6) gini FROM acto GROUP BY entity"),
    "activity_concentration": with_("SELECT entity, percent, round(sum(n) FILTER (m - i < ceil(m * percent / 100)) / sum(n), 6) share FROM acto CROSS JOIN (SELECT unnest([1, 5, 10, 20]) percent) GROUP BY ALL"),
    "non_monotonic_users": with_("SELECT count(*) users, count(*) FILTER (d) non_monotonic FROM (SELECT uid, bool_or(coalesce(before > ts_ms, false)) d FROM (SELECT *, lag(ts_ms) OVER (PARTITION BY uid ORDER BY event_id) before FROM inter) GROUP BY uid)"),
    "sequence_consistency": with_("SELECT count(*) users, count(*) FILTER (a IS DISTINCT FROM b) mismatched FROM (SELECT uid, list(item ORDER BY ts_ms, item) a, list(item ORDER BY event_id) b FROM inter GROUP BY uid)"),
    "title_coverage": with_("""SELECT (SELECT count(DISTINCT item) FROM inter) used_items, (SELECT count(DISTINCT doc_id) FROM documents) title_items,
      (SELECT count(DISTINCT item) FROM inter WHERE item NOT IN (SELECT doc_id FROM documents)) used_without_title, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT item FROM inter)) titles_unused,
      (SELECT count(DISTINCT item) FROM inter WHERE item NOT IN (SELECT vec_id FROM embeddings)) used_without_vector, (SELECT count(DISTINCT vec_id) FROM embeddings WHERE vec_id NOT IN (SELECT item FROM inter)) vectors_unused"""),
    "title_token_stats": with_("SELECT count(*) items, count(DISTINCT t) unique_titles, count(*) FILTER (t = '') empty_titles, " + ", ".join(f"max(l) FILTER (i = ceil(m * {p} / 100)) p{p}" for p in (25, 50, 75, 90)) + " FROM (SELECT t, len(toks) l, row_number() OVER (ORDER BY len(toks), item) i, count(*) OVER () m FROM names)"),
    "cutoff_timestamps": with_("SELECT c1 dev_ms, c2 final_ms FROM cuts"),
    "split_counts": with_(" UNION ALL ".join(count_row(n, t) for n, t in (("validation_train", "dev"), ("validation_cold", "vrows"), ("validation_warm", "vwarm"), ("test_train", "fin"), ("test_cold", "trows"), ("test_warm", "twarm")))),
    "cold_items": with_("SELECT 'validation' split, item FROM vcold UNION ALL SELECT 'test', item FROM tcold"),
    "cold_eval_rows": with_("SELECT 'validation' split, uid, item, ts_ms, event_id FROM vrows UNION ALL SELECT 'test', uid, item, ts_ms, event_id FROM trows"),
    "warm_eval_rows": with_("SELECT 'validation' split, uid, item, ts_ms, event_id FROM vwarm UNION ALL SELECT 'test', uid, item, ts_ms, event_id FROM twarm"),
    "split_invariants": with_(checks()),
    "audit_cold_feasibility": with_(cold_row("validation", "vwin", "dev") + " UNION ALL " + cold_row("test", "twin", "fin")),
    "token_document_frequency": with_("SELECT term, df FROM dfs"),
    "idf": with_("SELECT term, df, round(idf, 6) idf FROM idfs"),
    "tfidf_vectors": with_("SELECT item, term, round(w, 6) w FROM vec"),
    "zero_vectors": with_("SELECT 'train' pool, count(*) items FROM trainitems WHERE item NOT IN (SELECT item FROM vec) UNION ALL SELECT 'cold', count(*) FROM cand WHERE item NOT IN (SELECT item FROM vec)"),
    "user_text_profile": with_("SELECT uid, term, round(w, 6) w FROM prof"),
    "user_dense_profile": with_("SELECT uid, CAST(pos AS INT) pos, round(x, 6) + 0e0 x FROM dprof"),
    "text_scores": with_("SELECT uid, item, round(score, 6) score FROM tsc"),
    "text_topk": with_("SELECT uid, item, round(score, 6) score, rank FROM trk WHERE rank <= 50"),
    "text_metrics": with_(metrics_of("trk")),
    "text_diagnostics": with_("SELECT count(*) users, count(*) FILTER (uid NOT IN (SELECT uid FROM prof)) empty_profiles, count(*) FILTER (best = 0) all_zero_users FROM (SELECT uid, max(score) best FROM tsc GROUP BY uid)"),
    "title_overlap_audit": with_("""SELECT (SELECT count(*) FROM pos JOIN names USING (item) WHERE EXISTS (SELECT 1 FROM hist JOIN names n2 USING (item) WHERE hist.uid = pos.uid AND n2.t = names.t)) positives_in_own_history,
      (SELECT count(*) FROM cand JOIN names USING (item) WHERE t IN (SELECT t FROM trainitems JOIN names USING (item))) candidates_seen_in_train, (SELECT count(*) - count(DISTINCT t) FROM cand JOIN names USING (item)) repeated_candidate_titles"""),
    "random_metrics": with_(metrics_of("rnd"), f"rnd AS (SELECT uid, item, row_number() OVER (PARTITION BY uid ORDER BY md5(concat('{SEED}:', uid, ':', item)), item) rank FROM usr CROSS JOIN cand)"),
    "dense_scores_topk": with_("SELECT uid, item, round(score, 6) + 0e0 score, rank FROM vrk WHERE rank <= 50"),
    "visual_metrics": with_(metrics_of("vrk")),
    "visual_metrics_by_bucket": with_(f"SELECT bucket, k, {MEANS} FROM ({users_of('vrk')}) JOIN buckets USING (uid) GROUP BY ALL"),
    "hamming_nearest": hashes("SELECT item, nearest_item, CAST(distance AS INT) distance FROM near"),
    "hamming_histogram": hashes("SELECT CAST(distance AS INT) distance, count(*) items FROM near GROUP BY distance"),
    "clean_pool_metrics": with_(
        f"SELECT 'text' model, * FROM ({metrics_of('ctrk', 'cpos')}) UNION ALL SELECT 'visual', * FROM ({metrics_of('cvrk', 'cpos')})",
        *CLEAN,
        *[f"c{t}rk AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, md5(concat('{SEED}:', uid, ':', item)), item) rank FROM {t}sc WHERE item IN (SELECT item FROM ccand))" for t in "tv"],
    ),
    "rank_fusion_grid": with_("SELECT * FROM grid", FUSED, GRID),
    "rank_fusion_selected": with_("SELECT * FROM grid ORDER BY ndcg DESC, recall DESC, weight LIMIT 1", FUSED, GRID),
    "complementarity": with_("SELECT CASE WHEN t AND v THEN 'both' WHEN t THEN 'text_only' WHEN v THEN 'visual_only' ELSE 'neither' END category, count(*) users FROM hits GROUP BY 1", HITS),
    "topk_overlap": with_(overlap("trk", "vrk")),
    "gate_partition": with_(f'SELECT uid, {PART} AS "partition" FROM usr'),
    "gate_thresholds": with_("SELECT share, round(threshold, 6) threshold FROM thr", *GATE),
    "gate_dev_grid": with_(gated("(SELECT * FROM gr WHERE part = 'gate_dev')", "thr", "share"), *GATE),
    "gate_audit": with_(POLICIES, *AUDIT),
    "gate_contingency": with_(
        f"SELECT scope, {CATEGORY} category, count(*) users FROM (SELECT 'all' scope, th, vh FROM aud UNION ALL SELECT 'gated', th, vh FROM aud, settings WHERE policy = 'gate' AND top_score <= threshold) GROUP BY ALL",
        *AUDIT, "aud AS (SELECT * FROM gr WHERE part = 'gate_audit')"),
    "gate_acceptance": with_(f"SELECT g.ndcg > t.ndcg AND g.recall > t.recall accepted FROM ({POLICIES}) g, ({POLICIES}) t WHERE g.policy = 'gate' AND t.policy = 'text'", *AUDIT),
    "gate_partition_check": with_(f"SELECT count(*) users, count(*) FILTER (p = 'gate_dev') gate_dev, count(*) FILTER (p = 'gate_audit') gate_audit, 0::BIGINT in_both, count(*) FILTER (p IS NULL) in_none FROM (SELECT uid, {PART} p FROM usr)"),
    "first_seen": with_("SELECT item, first_ts FROM firsts", *PAIRS),
    "loo_targets": with_("SELECT uid, item, ts_ms FROM loo", *PAIRS),
    "availability_asof": with_("SELECT uid, item, available FROM avail", *PAIRS),
    "negative_samples": with_("SELECT uid, neg_item, CAST(draw AS INT) draw FROM negs", *PAIRS),
    "pair_features": with_("SELECT uid, neg_item, " + ", ".join(f"round({s}_{c}, 6) + 0e0 {s}_{c}" for s in ("pos", "neg") for c in ("text", "visual", "product")) + ", is_calibration FROM pairs", *PAIRS),
    "pair_standardization": with_("SELECT feature, round(mean, 6) mean, round(std, 6) std, round(low, 6) + 0e0 low, round(high, 6) + 0e0 high FROM stats", *PAIRS),
    "pair_accuracy": with_("SELECT feature, round(avg(CAST(p - n > 0 AS DOUBLE)), 6) strict_accuracy, round(avg(CAST(p - n = 0 AS DOUBLE)), 6) tie_rate FROM tall GROUP BY feature", *PAIRS),
    "learned_fusion_metrics": with_(metrics_of("lrk"), *LEARNED),
    "learned_fusion_clean_metrics": with_(metrics_of("clrk", "cpos"), *LEARNED, *CLEAN, f"clrk AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, md5(concat('{SEED}:', uid, ':', item)), item) rank FROM lsc WHERE item IN (SELECT item FROM ccand))"),
    "learned_fusion_overlap": with_(overlap("lrk", "trk"), *LEARNED),
    "pair_metadata": with_(
        "SELECT count(DISTINCT uid) users, count(*) pairs, " + ", ".join(f"count(DISTINCT uid) FILTER ({c}) {n}_users, count(*) FILTER ({c}) {n}_pairs" for c, n in (("NOT is_calibration", "train"), ("is_calibration", "calibration"))) + ", (SELECT min(available - (SELECT count(DISTINCT d.item) FROM dev d WHERE d.uid = a.uid)) FROM avail a WHERE uid IN (SELECT uid FROM pairs)) smallest_pool FROM pairs", *PAIRS),
    "acceptance_gate": with_(f"SELECT l.ndcg > t.ndcg AND l.recall > t.recall accepted FROM ({metrics_of('lrk')}) l, ({metrics_of('trk')}) t WHERE l.k = 10 AND t.k = 10", *LEARNED),
    "error_summary": with_("SELECT count(*) users, CAST(sum(z) AS BIGINT) zero_score_positives, round(avg(b), 6) mean_best_rank FROM (SELECT uid, min(rank) b, count(*) FILTER (score = 0) z FROM trk JOIN pos USING (uid, item) GROUP BY uid)"),
    "near_duplicate_audit": with_(
        f"SELECT * FROM (SELECT count(*) positives, count(*) FILTER (similarity >= 0.5) near_50, count(*) FILTER (similarity >= 0.8) near_80 FROM sims) CROSS JOIN (SELECT count(*) kept_users, round(avg(recall), 6) recall, round(avg(ndcg), 6) ndcg, round(avg(hit), 6) hit_rate FROM ({users_of('trk', 'keptp', TEN)}))",
        SIMILAR, "keptp AS (SELECT uid, item FROM sims WHERE similarity < 0.8)",
    ),
    "history_buckets": with_(f"SELECT bucket, {MEANS} FROM ({users_of('trk', 'pos', TEN)}) JOIN buckets USING (uid) GROUP BY bucket"),
    "case_strong_hits": with_("SELECT uid, best_item, best_rank, round(best_score, 6) best_score FROM allcases WHERE best_rank <= 3 AND NOT exact ORDER BY allcases.best_score DESC, uid LIMIT 5", *CASES),
    "case_confident_misses": with_(f"SELECT uid, best_item, best_rank, top_item, round(top_score, 6) top_score FROM allcases WHERE best_rank > {PROTOCOL.miss_beyond} AND allcases.top_score > 0 ORDER BY allcases.top_score DESC, uid LIMIT 5", *CASES),
    "exposure_summary": with_(exposure("text", "trk") + " UNION ALL " + exposure("visual", "vrk")),
    "demo_samples": with_(
        """SELECT bucket, outcome, p.uid, string_agg(t, '|' ORDER BY event_id) history_titles FROM picked p JOIN recent r ON r.uid = p.uid GROUP BY ALL""", HITS,
        "cands AS (SELECT bucket, CASE WHEN t THEN 'hit' ELSE 'miss' END outcome, uid, sha256('sample:' || uid) h FROM hits JOIN buckets USING (uid))",
        "picked AS (SELECT bucket, outcome, arg_min(uid, h) uid FROM cands GROUP BY ALL)",
        """recent AS (SELECT uid, event_id, CASE WHEN length(c) > 180 THEN concat(rtrim(substr(c, 1, 179)), '…') ELSE c END t FROM (SELECT hist.uid, event_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) c, row_number() OVER (PARTITION BY hist.uid ORDER BY event_id DESC) b
          FROM hist JOIN titles USING (item)) WHERE b <= 6)""",
    ),
    "history_catalog": with_("SELECT topic, item, place FROM catalog", *CATALOG),
    "explain_terms": with_("""SELECT uid, item, place, term, round(contribution, 6) contribution FROM (SELECT *, row_number() OVER (PARTITION BY uid, item ORDER BY contribution DESC, term) place FROM (
      SELECT r.uid, r.item, v.term, round(p.w * v.w, 9) contribution FROM trk r JOIN vec v ON v.item = r.item JOIN prof p ON p.uid = r.uid AND p.term = v.term WHERE r.rank <= 3 AND r.score > 0)) WHERE place <= 3"""),
    "simulate_interest": with_(
        "SELECT query, place, item, round(score, 6) score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) place FROM sim) WHERE place <= 10", TOPIC_ROWS,
        "qraw AS (SELECT topic query, term, (1 + ln(n)) * idf w FROM (SELECT topic, unnest(regexp_extract_all(lower(words), '[a-z0-9]+')) term, 1 n FROM topics) JOIN idfs USING (term))",
        "q AS (SELECT query, term, w / sqrt(sum(w * w) OVER (PARTITION BY query)) w FROM qraw)", f"sim AS ({SIM.format(q='q')})",
    ),
    "simulate_history": with_(
        "SELECT r.query, r.place, r.item, round(r.score, 6) score, e.evidence, round(e.s, 6) evidence_score FROM res r JOIN ev e ON e.item = r.item WHERE e.o = 1", *CATALOG,
        "chosen AS (SELECT 'mine' query, item, row_number() OVER (ORDER BY topic) pos FROM catalog WHERE place = 1)",
        "hq AS (SELECT query, term, w / sqrt(sum(w * w) OVER ()) w FROM (SELECT query, term, sum(w) w FROM chosen JOIN vec USING (item) GROUP BY ALL))",
        f"res AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, item) place FROM ({SIM.format(q='hq')})) WHERE place <= 10)",
        "ev AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY s DESC, pos) o FROM (SELECT res.item, c.item evidence, c.pos, coalesce(round((SELECT sum(a.w * b.w) FROM vec a JOIN vec b USING (term) WHERE a.item = res.item AND b.item = c.item), 9), 0) s FROM res CROSS JOIN chosen c))",
    ),
    "hash_boundary_audit": hashes("SELECT count(*) items, " + ", ".join(f"count(*) FILTER (distance <= {d}) within_{d}" for d in (0, 2, 5)) + " FROM near"),
    "hash_boundary_examples": hashes("SELECT item, nearest_item, CAST(distance AS INT) distance FROM near ORDER BY near.distance, item LIMIT 100"),
    "exact_duplicate_groups": with_("SELECT sha256(text) digest, count(*) n, min(doc_id) first_item, max(doc_id) last_item FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "duplicate_cross_boundary": with_("SELECT digest, count(*) n FROM (SELECT sha256(text) digest, doc_id IN (SELECT item FROM trainitems) t, doc_id IN (SELECT item FROM cand) c FROM documents) WHERE t OR c GROUP BY digest HAVING bool_or(t) AND bool_or(c)"),
    "self_join_similarity_top10": with_("""SELECT item_a, item_b, round(s, 6) + 0e0 similarity FROM (SELECT a.item item_a, b.item item_b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 9) s FROM emb a JOIN emb b ON a.pos = b.pos AND a.item < b.item
      WHERE a.item IN (SELECT item FROM cand) AND b.item IN (SELECT item FROM cand) GROUP BY ALL) ORDER BY s DESC, item_a, item_b LIMIT 10"""),
    "dhash_from_grid": """SELECT part, string_agg(printf('%X', nibble), '' ORDER BY y, h) dhash FROM (SELECT part, y, x // 4 h, CAST(sum(CASE WHEN (part * 31 + y * 17 + x * x * part) % 256 > (part * 31 + y * 17 + (x + 1) * (x + 1) * part) % 256 THEN 1 << (3 - x % 4)::INT ELSE 0 END) AS BIGINT) nibble
      FROM (SELECT CAST(p_partkey AS BIGINT) part FROM part) CROSS JOIN range(0, 8) a(y) CROSS JOIN range(0, 8) b(x) GROUP BY ALL) GROUP BY part""",
}
SQL |= {f"final_{n}": final(SQL[n]) for n in ("text_metrics", "visual_metrics", "clean_pool_metrics", "rank_fusion_grid", "hamming_nearest", "hash_boundary_audit")}
