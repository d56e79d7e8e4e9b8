"""Queries of text identity, washing, near-duplicates, tokens and word families, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.texts import EMOTICONS, STOP_WORDS, normalized, tokens
from weft.operators import columns as C
from weft.operators import dedupe as D
from weft.operators import joins as J
from weft.operators import segment as SG
from weft.operators import stats as ST
from weft.operators import text as T
from weft.runtime import load

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# SQL has no back references: runs are cut to two for each character that the tables can hold
_CHARACTERS = [chr(c) for c in range(33, 127)] + [chr(c) for c in range(0xA1, 0x100)] + [" "]


def _chain(sql: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        sql = f"regexp_replace({sql}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return sql


def _runs(sql: str) -> str:
    return _chain(sql, *[(rf"\x{{{ord(c):x}}}{{3,}}", c.replace("'", "''").replace("\\", "\\\\") * 2) for c in _CHARACTERS])


_NAME = r"@[^\s@:：,，。！？!?、；;/]{1,30}"
_REPLY, _QUOTED = rf"\s*(?:回复)?\s*{_NAME}\s*[:：]\s*", rf"//\s*[^\s@:：]*\s*{_NAME}\s*[:：]\s*"


def sql_normalized(x: str) -> str:
    """The normalised text, for texts that are in Unicode form KC already."""
    links = r"(?:展开|收起)[0-9A-Za-z]{1,3}|L?微博视频[0-9A-Za-z]*|[Oo]?网页链接|https?://\S+|www\.\S+"
    x = _chain(x, (links, " "), (rf"\[(?:[A-Za-z0-9_]{{1,16}}|{'|'.join(EMOTICONS)})\]", " "), (r"#([^#]{0,40})#", r"\1"), (rf"(?s)^\s*(?:{_REPLY})?{_QUOTED}(?:.*{_QUOTED})?", ""), (rf"(?s){_QUOTED}.*$", ""), (f"^{_REPLY}", ""), (rf"{_NAME}[:：]?", " "))
    return f"trim({_chain(_runs(x), (r'\s+', ' '))})"


# Texts as they are reposted: by a reply, behind own words, with a topic, an emoticon and a link.
_DISGUISED = """SELECT doc_id, lang, CASE doc_id % 6 WHEN 0 THEN '@user ' || text WHEN 1 THEN '回复@user: ' || text WHEN 2 THEN '//@a:quoted words //@b: ' || text WHEN 3 THEN text || ' //@c: quoted words'
  WHEN 4 THEN '[doge]' || text || ' O网页链接 https://t.example/x' ELSE '#' || 'Ａ topic' || '#' || text END AS text FROM documents"""
_DISGUISED_SQL = _DISGUISED.replace("Ａ topic", "A topic")  # in form KC


def disguised(spark, d):
    load(spark, d, "documents").createOrReplaceTempView("weft_documents")
    return spark.sql(_DISGUISED.replace("FROM documents", "FROM weft_documents"))


@query("normalize_text", f"SELECT doc_id, {sql_normalized('text')} AS text FROM ({_DISGUISED_SQL})")
def _(spark, d):
    return disguised(spark, d).select("doc_id", normalized(F.col("text")).alias("text"))


@query("drop_duplicates_normalized", f"WITH t AS (SELECT doc_id, {sql_normalized('text')} AS x FROM ({_DISGUISED_SQL})) SELECT min(doc_id) AS doc_id FROM t WHERE x <> '' GROUP BY x UNION ALL SELECT doc_id FROM t WHERE x = ''")
def _(spark, d):
    return D.drop_duplicates(disguised(spark, d), ["text"], "first", "doc_id", "normalized").select("doc_id")


_WASHED = _chain(
    _runs(_chain("text", (r"https?://\S+|www\.\S+", " "), (r"O?网页链接|L微博视频|微博视频|查看图片", " "), (r"回复\s*@\S{1,30}?\s*[:：]", " "), (r"(?s)//\s*@\S{1,30}?\s*[:：].*$", ""), (r"(?s)\n.*$", ""), (r"@[A-Za-z0-9_\-\x{4e00}-\x{9fa5}]{1,30}", " "), (r"#([^#\n]{1,40})#", r"\1"), (r"\[[^\[\]\n]{1,10}\]", " "), (r"(?:[Vv]信|微信|QQ|qq|扣扣)\s*[:：]?\s*[A-Za-z0-9_\-]{4,20}|[1-9]\d{4,11}", " "))),
    (r"\s+", " "),
)


@query("wash", rf"WITH w AS (SELECT doc_id, trim({_WASHED}) AS x FROM ({_DISGUISED})) SELECT doc_id, CASE WHEN len(x) >= 2 AND regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN x ELSE '' END AS cleaned_text, CASE WHEN len(x) >= 2 AND regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN 'keep' ELSE 'drop' END AS action FROM w")
def _(spark, d):
    return T.wash(disguised(spark, d), "text").select("doc_id", "cleaned_text", "action")


@query("anti_join_text", f"SELECT doc_id FROM ({_DISGUISED_SQL}) WHERE {sql_normalized('text')} = '' OR {sql_normalized('text')} NOT IN (SELECT {sql_normalized('text')} FROM conversations WHERE text IS NOT NULL)")
def _(spark, d):
    return J.anti_join(disguised(spark, d), load(spark, d, "conversations"), "text", "text", mode="text").select("doc_id")


# near-duplicates: fingerprints, then all pairs of them and reachability

_BITS = " | ".join(f"((sum(CASE WHEN (h >> {b}) & 1 = 1 THEN n ELSE -n END) > 0)::UBIGINT << {b})" for b in range(64))
_PRINTS = rf"""words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower({sql_normalized('text')}), '[\p{{L}}\p{{N}}]+')) AS w FROM SOURCE),
counts AS (SELECT id, w, count(*) AS n FROM words GROUP BY 1, 2),
hashes AS (SELECT w, ('0x' || substr(sha1(w), 1, 16))::UBIGINT AS h FROM (SELECT DISTINCT w FROM counts)),
prints AS (SELECT id, {_BITS} AS fp FROM counts JOIN hashes USING (w) GROUP BY id)"""
_GROUPS = """firsts AS (SELECT fp, min(id) AS least FROM prints GROUP BY 1),
pairs AS (SELECT a.fp AS a, b.fp AS b FROM firsts a JOIN firsts b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::BIGINT::BIT) <= {most}),
reach AS (SELECT fp, fp AS other FROM firsts UNION SELECT r.fp, p.b FROM reach r JOIN pairs p ON p.a = r.other),
named AS (SELECT r.fp, min(f.least) AS grp FROM reach r JOIN firsts f ON f.fp = r.other GROUP BY 1),
grouped AS (SELECT id, grp FROM prints JOIN named USING (fp))"""
_GROUPS = _GROUPS.replace("bit_count(xor(a.fp, b.fp)::BIGINT::BIT)", "bit_count(xor(a.fp, b.fp))")


def _groups_sql(source: str, most: int, rest: str) -> str:
    return f"WITH RECURSIVE {_PRINTS.replace("SOURCE", source)}, {_GROUPS.format(most=most)} {rest}"


@query("simhash64", f"WITH {_PRINTS.replace('SOURCE', 'documents')} SELECT id, fp::VARCHAR AS fp FROM prints")
def _(spark, d):
    prints = D.with_simhash(load(spark, d, "documents"), "doc_id", "text")
    return prints.select("id", F.when(F.col("fp") >= 0, F.col("fp").cast("decimal(20,0)")).otherwise(F.col("fp").cast("decimal(20,0)") + F.expr("18446744073709551616BD")).cast("string").alias("fp"))


@query("near_groups", _groups_sql("documents", 8, 'SELECT id, grp AS "group" FROM grouped'))
def _(spark, d):
    return D.near_groups(load(spark, d, "documents"), "doc_id", "text", 8)


@query("dedupe_similar", _groups_sql("documents", 3, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM grouped WHERE id <> grp)"))
def _(spark, d):
    return D.dedupe_similar(load(spark, d, "documents"), "text", "doc_id", 3).select("doc_id")


@query("anti_join_similar", _groups_sql("(SELECT 'a' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark)", 8, "SELECT doc_id FROM documents WHERE 'a' || doc_id NOT IN (SELECT id FROM grouped WHERE grp IN (SELECT grp FROM grouped WHERE id[1] = 'b'))"))
def _(spark, d):
    return D.similar_semi(load(spark, d, "documents"), load(spark, d, "benchmark"), "text", "text", "doc_id", "item_id", 8).select("doc_id")


@query("near_semi", _groups_sql("(SELECT 'a' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'b' || conv_id || '.' || turn, text FROM conversations)", 8, "SELECT doc_id FROM documents WHERE 'a' || doc_id IN (SELECT id FROM grouped WHERE grp IN (SELECT grp FROM grouped WHERE id[1] = 'b'))"))
def _(spark, d):
    turns = load(spark, d, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("turn"), "text")
    return D.similar_semi(load(spark, d, "documents"), turns, "text", "text", "doc_id", "turn", 8, "keep").select("doc_id")


_AUTHORS = "(SELECT d.doc_id, d.text, e.user_id AS author, e.ts FROM documents d JOIN (SELECT event_id AS doc_id, user_id, ts FROM events) e USING (doc_id) WHERE e.user_id IS NOT NULL)"


@query(
    "bot_scores",
    f"""WITH posts AS {_AUTHORS}, {_PRINTS.replace('SOURCE', 'posts')},
signed AS (SELECT p.doc_id, p.author, f.fp FROM posts p JOIN prints f ON f.id = p.doc_id), by_print AS (SELECT DISTINCT fp, author FROM signed),
dup AS (SELECT s.author, count(*) AS dup FROM signed s WHERE EXISTS (SELECT 1 FROM by_print b WHERE b.author <> s.author AND bit_count(xor(b.fp, s.fp)) <= 3) GROUP BY 1),
spans AS (SELECT author, count(*) OVER (PARTITION BY author ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN CURRENT ROW AND 600 FOLLOWING) AS n FROM posts),
peaks AS (SELECT author, CASE WHEN count(*) >= 5 THEN max(n) END AS peak FROM spans GROUP BY 1), usual AS (SELECT coalesce(median(peak), 0) AS usual FROM peaks),
scored AS (SELECT p.author, count(*) AS posts, coalesce(any_value(d.dup), 0) / count(*) AS ratio, any_value(k.peak) AS peak, CASE WHEN any_value(u.usual) > 0 AND any_value(k.peak) > any_value(u.usual) THEN least(1.0::DOUBLE, (any_value(k.peak) - any_value(u.usual)) / (2 * any_value(u.usual))) ELSE 0.0::DOUBLE END AS burst
  FROM posts p LEFT JOIN dup d USING (author) LEFT JOIN peaks k USING (author), usual u GROUP BY 1)
SELECT author, posts, round(ratio, 4) AS dup_ratio, coalesce(peak, 0) AS peak, round(ratio * 0.6 + burst * 0.4, 4) AS bot_score, CASE WHEN round(ratio * 0.6 + burst * 0.4, 4) >= 0.67 THEN 'likely' WHEN round(ratio * 0.6 + burst * 0.4, 4) >= 0.34 THEN 'suspect' ELSE 'none' END AS bot_level FROM scored""",
)
def _(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("doc_id"), "user_id", "ts")
    return ST.bot_scores(load(spark, d, "documents").join(e, "doc_id"), "doc_id", "user_id", "text", "ts")


@query(
    "semantic_dedupe",
    """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x * x)) > 0),
near AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k < b.k AND list_cosine_similarity(a.e, b.e) >= 0.45),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL SELECT w.k + 1, CASE WHEN list_contains(w.gone, w.k + 1) THEN w.gone ELSE list_distinct(list_concat(w.gone, coalesce((SELECT list(b) FROM near WHERE a = w.k + 1), []))) END FROM walk w WHERE w.k < (SELECT max(k) FROM v)),
last AS (SELECT gone FROM walk ORDER BY k DESC LIMIT 1)
SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT v.id FROM v, last WHERE list_contains(last.gone, v.k))""",
)
def _(spark, d):
    return D.semantic_dedupe(load(spark, d, "embeddings"), "vec_id", "embedding", 0.45).select("vec_id")


# tokens of mixed writing, word families, numbers in text cells

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_HAN = "translate(doc_id::VARCHAR, '0123456789', '零一二三四五六七八九')"


@query(
    "tokenize_mixed",
    rf"""WITH t AS (SELECT doc_id, {_HAN} AS h, text FROM documents), w AS (
  SELECT doc_id, unnest(list_concat(CASE WHEN len(h) = 1 THEN [h] ELSE list_transform(range(1, len(h)), lambda i: substr(h, i, 2)) END, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'))) AS w FROM t)
SELECT doc_id, count(*) AS n_words, count(DISTINCT w) AS n_distinct, max(w) AS last_word FROM w WHERE len(w) >= 2 AND NOT regexp_matches(w, '^\p{{N}}+$') AND w NOT IN ({_STOP}) GROUP BY 1""",
)
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.translate(F.col("doc_id").cast("string"), "0123456789", "零一二三四五六七八九"), F.lit(" "), "text").alias("text"))
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("w"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_distinct("w").alias("n_distinct"), F.max("w").alias("last_word"))


@query(
    "tokenize_lexicon",
    rf"""WITH t AS (SELECT doc_id, '在' || CASE doc_id % 3 WHEN 0 THEN '北京大学' WHEN 1 THEN '北京' ELSE '大学城' END || '见' AS x FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '在|北京大学|见' WHEN 1 THEN '在|北京|见' ELSE '在|大学|城见' END AS words FROM t""",
)
def _(spark, d):
    from weft.functions.texts import words

    ids = load(spark, d, "documents").select("doc_id", F.concat(F.lit("在"), F.when(F.col("doc_id") % 3 == 0, "北京大学").when(F.col("doc_id") % 3 == 1, "北京").otherwise("大学城"), F.lit("见")).alias("x"))
    return ids.select("doc_id", F.array_join(words(F.col("x"), ("北京", "北京大学", "大学")), "|").alias("words"))


# words of Han text: the words of parts and of their events run together, each written as two or three characters

_HAN_WORD = "translate(substr(md5(W), 1, CASE WHEN substr(md5(W), 4, 1) < '8' THEN 2 ELSE 3 END), '0123456789abcdef', '天地玄黄宇宙洪荒日月盈昃辰宿列张')"
_PLANTED = f"""SELECT p_partkey, list_transform(string_split(lower(p_type || ' ' || p_name || ' ' || replace(p_brand, '#', '')), ' '), lambda w: {_HAN_WORD.replace('W', 'w')}) AS planted FROM part"""
_RUNS = rf"runs AS (SELECT run, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(t, '\p{{Han}}+')) AS run FROM (SELECT array_to_string(planted, '') || ' ok' AS t FROM ({_PLANTED}))) GROUP BY 1)"
_LEARNED = f"""{_RUNS},
grams AS (SELECT substr(run, i, k) AS word, CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '' END AS before, substr(run, i + k, 1) AS behind, n
  FROM (SELECT run, n, unnest(range(1, len(run) + 1)) AS i FROM runs), range(1, 5) r(k) WHERE i + k - 1 <= len(run)),
sides AS (SELECT word, 0 AS side, before AS x, sum(n) AS n FROM grams GROUP BY 1, 3 UNION ALL SELECT word, 1, behind, sum(n) FROM grams GROUP BY 1, 3),
counts AS (SELECT word, any_value(n) AS n, min(h) AS freedom FROM (SELECT word, side, sum(n)::BIGINT AS n, ln(sum(n)) - sum(CASE WHEN x = '' THEN 0 ELSE n * ln(n) END) / sum(n) AS h FROM sides GROUP BY 1, 2) GROUP BY 1),
total AS (SELECT sum(n)::DOUBLE AS total FROM counts WHERE len(word) = 1),
cuts AS (SELECT c.word, min(ln(c.n::DOUBLE * total / (l.n::DOUBLE * r.n))) AS cohesion FROM (SELECT word, n, unnest(range(1, len(word))) AS k FROM counts WHERE len(word) > 1 AND n >= 5) c, total
  JOIN counts l ON l.word = substr(c.word, 1, c.k) JOIN counts r ON r.word = substr(c.word, c.k + 1) GROUP BY 1),
lexicon AS (SELECT word, n, cohesion, freedom FROM counts JOIN cuts USING (word) WHERE n >= 5 AND cohesion >= 2 AND freedom >= 1 UNION ALL SELECT word, n, NULL, NULL FROM counts WHERE len(word) = 1)"""


def planted(spark, d):
    word = "translate(substr(md5(w), 1, if(substr(md5(w), 4, 1) < '8', 2, 3)), '0123456789abcdef', '天地玄黄宇宙洪荒日月盈昃辰宿列张')"
    words = F.expr(f"transform(split(lower(concat(p_type, ' ', p_name, ' ', replace(p_brand, '#', ''))), ' '), w -> {word})")
    return load(spark, d, "part").select("p_partkey", F.concat(F.array_join(words, ""), F.lit(" ok")).alias("text"))


@query("lexicon_learned", f"WITH {_LEARNED} SELECT word, n, round(cohesion, 6) AS cohesion, round(freedom, 6) AS freedom FROM lexicon")
def _(spark, d):
    found = SG.learn_lexicon(planted(spark, d), "text", min_cohesion=2.0)
    return found.select("word", "n", F.round("cohesion", 6).alias("cohesion"), F.round("freedom", 6).alias("freedom"))


@query(
    "tokenize_learned",
    f"""WITH RECURSIVE {_LEARNED},
costs AS (SELECT word, round(1000000 * ln((SELECT sum(n) FROM lexicon)::DOUBLE / n))::BIGINT AS cost FROM lexicon),
edges AS (SELECT run, i + k - 1 AS stop, k, cost FROM (SELECT run, unnest(range(1, len(run) + 1)) AS i FROM runs), range(1, 5) r(k) JOIN costs ON word = substr(run, i, k) WHERE i + k - 1 <= len(run)),
best AS (SELECT run, 0::BIGINT AS i, [0::BIGINT] AS cost, []::BIGINT[] AS step FROM runs UNION ALL
  SELECT run, i + 1, list_append(cost, c[1]), list_append(step, -c[2]) FROM (SELECT b.run, b.i, b.cost, b.step, (SELECT min([b.cost[e.stop - e.k + 1] + e.cost, -e.k]) FROM edges e WHERE e.run = b.run AND e.stop = b.i + 1) AS c FROM best b WHERE b.i < len(b.run))),
walk AS (SELECT run, step, len(run)::BIGINT AS pos, []::VARCHAR[] AS words FROM best WHERE i = len(run) UNION ALL SELECT run, step, pos - step[pos], list_prepend(substr(run, pos - step[pos] + 1, step[pos]), words) FROM walk WHERE pos > 0),
cut AS (SELECT run, words FROM walk WHERE pos = 0)
SELECT p_partkey, array_to_string(words, '|') || '|ok' AS words FROM (SELECT p_partkey, array_to_string(planted, '') AS run FROM ({_PLANTED})) JOIN cut USING (run)""",
)
def _(spark, d):
    return SG.cut_words(planted(spark, d), "text", min_cohesion=2.0).select("p_partkey", F.array_join("words", "|").alias("words"))


_HOSTILE = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '废物 ' WHEN 1 THEN '听说 ' WHEN 2 THEN '废物，垃圾，废物 ' WHEN 3 THEN '他也配 ' WHEN 4 THEN '开盒 ' WHEN 5 THEN '听说要开盒，废物 ' ELSE '' END || regexp_replace(text, '[0-9@]', '', 'g') AS text FROM documents"""


@query(
    "aggression",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'mild' WHEN 1 THEN 'none' WHEN 2 THEN 'severe' WHEN 3 THEN 'mild' WHEN 4 THEN 'severe' WHEN 5 THEN 'severe' ELSE 'none' END AS aggression,
  CASE doc_id % 7 WHEN 0 THEN 0.45 WHEN 1 THEN 0.2 WHEN 2 THEN 0.55 WHEN 3 THEN 0.3 WHEN 4 THEN 0.6 WHEN 5 THEN 0.825 ELSE 0 END::DOUBLE AS aggression_score,
  CASE doc_id % 7 WHEN 0 THEN 'abuse:废物' WHEN 1 THEN 'rumour:听说' WHEN 2 THEN 'abuse:废物、垃圾' WHEN 3 THEN 'attack:也配' WHEN 4 THEN 'privacy:开盒' WHEN 5 THEN 'privacy:开盒；abuse:废物；rumour:听说' ELSE '' END AS aggression_hits FROM documents""",
)
def _(spark, d):
    load(spark, d, "documents").createOrReplaceTempView("weft_documents")
    docs = spark.sql(_HOSTILE.replace("FROM documents", "FROM weft_documents").replace(", 'g')", ")"))
    return T.aggression(docs, "text").select("doc_id", "aggression", "aggression_score", "aggression_hits")


for _op, _value, _sql in (("eq", "25.0", "s = 25"), ("ne", "25", "s <> 25"), ("in", "25.00, 7", "s IN (25, 7)"), ("not_in", "25, 7.0", "s NOT IN (25, 7)")):
    QUERIES[f"filter_{_op}_text"] = lambda spark, d, op=_op, value=_value: C.filter_rows(load(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise("")).alias("s")), "s", op, value).select("p_partkey")
    ORACLES[f"filter_{_op}_text"] = f"SELECT p_partkey FROM (SELECT p_partkey, p_size AS s FROM part) WHERE {_sql}"


@query("filter_eq_mixed", "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_size = 25")
def _(spark, d):
    parts = load(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "25.0").when(F.col("p_partkey") % 5 == 1, F.col("p_size").cast("string")).otherwise(F.coalesce(F.col("p_size").cast("string"), F.lit("?"))).alias("s"))
    return C.filter_rows(parts.unionByName(parts.limit(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("many").alias("s"))), "s", "eq", "25").select("p_partkey")
