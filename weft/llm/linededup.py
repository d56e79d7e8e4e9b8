r"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are sequences of words (``[^\x20\x09-\x0D]+``). Equal sequences are one line, kept where
it comes first. Two different lines of ``min_words`` words or more are near if one word
inserted, deleted or replaced turns one into the other (one of five words is a similarity of
0.8). Each line emits its variants, itself and itself without one word, as hashed keys. Two
lines are near exactly if they share a variant made at the same place of lines of the same
length, or if one is a variant of the other.

A word edit leaves the first or the last words of a line as they were, up to half of the
shorter line, so only lines that share such a part with another emit variants, and only those
that keep the shared part; all others can have no near line. The part is the largest of 1, 2,
3, 4, 6, 8, 12, 16, ... words that fits in half a line; a line one word longer mostly has the
same part, and emits both where it has not. A variant's key is the exclusive or of the hashes
of its words, each with its place in the variant, so running sums over a line give all its keys
in one pass. Within a variant made at one place all lines are near each other, so the earliest
is found by a minimum and no pairs of a group are listed. Each line is then compared with the
earliest line that a key gives: their words before and after the edit must be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, IntegralType

from weft.errors import OpError, need_columns
from weft.operators.skew import BROADCAST_ROWS, join_table
from weft.runtime import checkpoint

#: Documents with candidate lines that are broadcast to find their texts (some 100 bytes each); more are joined by a shuffle.
BROADCAST_DOCUMENTS = 200_000
#: Keys that lines share, and whole lines, which are broadcast (some 20 to 60 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: White space that is no line break; how many line numbers and how many hashes of texts a place leaves room for; the first number that is no id.
_ODD, _LINES, _TEXTS, _NO_ID = ("  ", "\t", "\x0b", "\x0c", "\r"), 2**31, 2**21, f"{-(2**63) - 1}BD"


def squeezed(line: Column) -> Column:
    """The words of a line with one space between them."""
    odd = line.startswith(" ") | line.endswith(" ")
    for c in _ODD:
        odd = odd | line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def _named(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``(doc, t, text)`` and ``more``: what names a row, in the order of ids, those without one first; and some bits of a hash of its text.

    A row without an id is named by its text: below all whole numbers, or in a struct for ids of other types.
    """
    text = F.col(text_col)
    own = F.pmod(F.xxhash64(text), F.lit(2**63 - 1))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        doc = F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.expr(_NO_ID) - own.cast("decimal(20,0)")).cast("decimal(20,0)")
    else:
        doc = F.struct(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), own).alias("own"))
    return docs.select(doc.alias("doc"), F.pmod(F.xxhash64(F.lit(7), text), F.lit(_TEXTS)).cast("int").alias("t"), text.alias("text"), *more)


def _place(kind: DataType) -> Column:
    """One value for ``doc``, ``line`` and ``t`` in their order: a decimal for whole numbers, which a hash aggregation can hold, else a struct."""
    if isinstance(kind, DecimalType):
        return F.expr(f"cast((cast(doc as decimal(20,0)) * {_LINES}BD + line) * {_TEXTS}BD + t as decimal(38,0))")
    return F.struct("doc", "line", "t")


def _of_place(place: str, kind: DataType) -> Column:
    """``(doc, line, t)`` of a place as a struct again."""
    if not isinstance(kind, DecimalType):
        return F.col(place)
    t = f"pmod({place}, {_TEXTS}BD)"
    number = f"cast(({place} - {t}) / {_TEXTS}BD as decimal(31,0))"
    line = f"pmod({number}, {_LINES}BD)"
    return F.expr(f"if({place} is null, null, struct(cast(({number} - {line}) / {_LINES}BD as decimal(20,0)) as doc, cast({line} as int) as line, cast({t} as int) as t))")


def _id(doc: Column, kind: DataType) -> Column:
    """The id of a row's name, null for one without."""
    if isinstance(kind, IntegralType):
        return F.when(doc > F.expr(_NO_ID), doc).cast(kind)
    return doc["id"]


def _part(n: str) -> str:
    """SQL for the part's size in a line of ``n`` words: the largest power of 2, or one and a half of it, up to half of n."""
    half = f"greatest(({n}) div 2, 1)"
    power = f"shiftleft(1, length(bin({half})) - 1)"
    return f"cast(if(2 * {half} >= 3 * {power} and {power} > 1, 3 * {power} div 2, {power}) as int)"


def _ends(h: str, only: str) -> list[Column]:
    """Hashes of the first and of the last ``h`` words of ``s``, where ``only`` holds."""
    return [F.expr(f"if({only}, xxhash64({side}, {h}, substring_index(s, ' ', {sign}{h})), null)") for side, sign in ((0, ""), (1, "-"))]


def _small(rows: DataFrame) -> DataFrame:
    """Checkpointed rows, marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def _distinct_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``(place, n, f, parts)`` of each distinct line: its first place, its number of words, a hash, and the keys of its parts."""
    lines = docs.select("doc", "t", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.select("doc", "t", "line", squeezed(F.col("text")).alias("s")).where("s <> ''")
    lines = lines.withColumn("n", F.octet_length("s") - F.octet_length(F.replace(F.col("s"), F.lit(" "), F.lit(""))) + 1)
    lines = lines.withColumn("h", F.expr(_part("n"))).withColumn("i", F.expr(_part("n - 1")))
    parts = [c.alias(name) for c, name in zip(_ends("h", f"n >= {min_words}") + _ends("i", f"n >= {min_words} and i <> h"), ("p0", "s0", "p1", "s1"), strict=True)]
    keyed = lines.select(_place(docs.schema["doc"].dataType).alias("place"), "n", F.xxhash64("s").alias("f"), F.expr("xxhash64(7, s)").alias("g"), *parts)
    return checkpoint(keyed.groupBy("n", "f", "g", "p0", "s0", "p1", "s1").agg(F.min("place").alias("place")))


def _candidates(docs: DataFrame, distinct: DataFrame, min_words: int) -> DataFrame:
    """``(place, f, n, low, high, s)``: lines that share a part with another, and the places that an edit outside of it can have."""
    sides = F.array(*[F.struct(F.col(c).alias("key"), F.lit(c[0] == "p").alias("front")) for c in ("p0", "s0", "p1", "s1")])
    parts = distinct.where(F.col("n") >= min_words).select("place", "f", F.explode(sides).alias("part")).select("place", "f", "part.*").where("key is not null")
    shared = checkpoint(parts.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("key"))
    chosen = parts.join(_small(shared), "key", "left_semi").groupBy("place", "f").agg(F.bool_or("front").alias("front"), F.bool_or(~F.col("front")).alias("back"))
    chosen = chosen.select(_of_place("place", docs.schema["doc"].dataType).alias("at"), "place", "f", "front", "back")
    by_doc = checkpoint(chosen.groupBy("at.doc", "at.t").agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "place", "f", "front", "back")).alias("wanted")))  # lines of one text
    few = by_doc.count() <= BROADCAST_DOCUMENTS
    found = docs.join(F.broadcast(by_doc) if few else by_doc, ["doc", "t"])
    split = found.select("wanted", F.inline(F.expr("array(struct(split(text, '\\n') as lines))")))  # a generator, so that a text is split once
    texts = split.select(F.inline(F.expr("transform(wanted, w -> struct(w.place, w.f, w.front, w.back, get(lines, w.line) as text))"))).withColumn("s", squeezed(F.col("text")))
    texts = texts.where(F.xxhash64("s") == F.col("f")).groupBy("place", "f", "front", "back").agg(F.first("s").alias("s"))
    n, i = "size(split(s, ' '))", _part("n - 1")
    texts = texts.withColumn("n", F.expr(n)).withColumn("low", F.expr(f"if(back, 1, {i} + 1)")).withColumn("high", F.expr(f"if(front, n, n - {i})"))
    return checkpoint(texts.select("place", "f", "n", "low", "high", "s"))


def _variants(candidates: DataFrame) -> DataFrame:
    """``(place, f, n, pos, m, key)``: each line (pos 0) and its variants without the word at ``pos``; ``m`` words have the hash ``key``."""
    words = candidates.repartition("place", "f").select("place", "f", "n", "low", "high", F.posexplode(F.split("s", " ")).alias("i", "word"))
    words = words.select("place", "f", "n", "low", "high", (F.col("i") + 1).alias("pos"), F.xxhash64("word", F.col("i") + 1).alias("x"), F.xxhash64("word", "i").alias("y"))
    order = Window.partitionBy("place", "f").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = words.withColumn("run", F.bit_xor(F.col("x").bitwiseXOR(F.col("y"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = words.withColumn("all_y", F.bit_xor("y").over(whole)).withColumn("all_x", F.bit_xor("x").over(whole))
    rest = F.col("run").bitwiseXOR(F.col("x")).bitwiseXOR(F.col("all_y"))
    less = F.when(F.col("pos").between(F.col("low"), F.col("high")), F.struct("pos", (F.col("n") - 1).alias("m"), rest.alias("key")))
    line = F.when(F.col("pos") == 1, F.struct(F.lit(0).alias("pos"), F.col("n").alias("m"), F.col("all_x").alias("key")))
    return words.select("place", "f", "n", F.explode(F.array(less, line)).alias("v")).where("v is not null").select("place", "f", "n", "v.*")


def _kept(docs: DataFrame, max_edits: int, min_words: int) -> DataFrame:
    """``(doc, line, t, near)`` of each distinct line of named rows; ``near`` is a place as a struct."""
    if max_edits not in (0, 1):
        raise OpError("line_dedup", "max_edits", f"{max_edits!r}: 0 and 1 word edits are supported")
    if not isinstance(min_words, int) or min_words < 2:
        raise OpError("line_dedup", "min_words", f"{min_words!r} must be a whole number of 2 or more")
    kind = docs.schema["doc"].dataType
    distinct = _distinct_lines(docs, min_words)
    if not max_edits:
        return distinct.select(_of_place("place", kind).alias("first")).select("first.*", F.when(F.lit(False), F.col("first")).alias("near"))
    candidates = _candidates(docs, distinct, min_words)
    variants = checkpoint(_variants(candidates))
    less = variants.where("pos > 0")
    meet = less.groupBy("key", "m", "pos").agg(F.min("place").alias("other"), F.max("place").alias("last")).where("other < last").select("key", "m", F.col("pos").alias("at"), "other")
    lines = variants.where("pos = 0").select("key", "m", F.lit(0).alias("at"), F.col("place").alias("other"))
    partners = checkpoint(meet.unionByName(lines))
    several = partners.count()
    if several <= BROADCAST_KEYS:
        pairs = less.join(F.broadcast(partners), ["key", "m"]).where("at in (0, pos)")
    else:
        n = less.count()
        pairs = _by_key(less.withColumn("at", F.col("pos")), partners.where("at > 0"), several, n).unionByName(_by_key(less.withColumn("at", F.lit(0)), partners.where("at = 0"), several, n))
    pairs = pairs.where("place <> other").select(F.greatest("place", "other").alias("later"), F.least("place", "other").alias("earlier"), "n", "pos").distinct()
    pairs = checkpoint(pairs)
    a = candidates.select(F.col("place").alias("later"), "f", F.col("s").alias("a"))
    b = candidates.select(F.col("place").alias("earlier"), F.col("s").alias("b"))
    hot = pairs.groupBy("earlier").agg(F.count(F.lit(1)).alias("n"))  # one line can be the earlier one of very many
    verified = join_table(pairs.join(a, "later"), b, "earlier", hot, BROADCAST_ROWS + 1, pairs.count()).where("substring_index(a, ' ', pos - 1) = substring_index(b, ' ', pos - 1) and substring_index(a, ' ', pos - n) = substring_index(b, ' ', pos - n)")
    near = verified.groupBy(F.col("later").alias("place"), "f").agg(F.min("earlier").alias("near"))
    both = distinct.join(near, ["place", "f"], "left")
    return both.select(_of_place("place", kind).alias("first"), _of_place("near", kind).alias("near")).select("first.*", "near")


def _by_key(less: DataFrame, partners: DataFrame, several: int, rows: int) -> DataFrame:
    """Variants with the one partner under their key, length and place; keys that many share are dealt out."""
    hashed = F.xxhash64("key", "m", "at").alias("__k")
    mine = less.select("*", hashed)
    table = partners.groupBy(hashed).agg(F.min(F.struct("key", "m", "other")).alias("p"))
    return join_table(mine, table, "__k", mine.groupBy("__k").agg(F.count(F.lit(1)).alias("n")), several, rows).where("key = p.key and m = p.m").select(*less.columns, "p.other")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_words: int = 5) -> DataFrame:
    """``(id, line, near)``: where each distinct line comes first; ``near`` is the earliest line before it that is near, or null.

    The first comes first by id, then by line. A line stays if it is there without ``near``.
    An earlier near line counts whether it stays itself or not. Null and blank texts have no
    lines; blank lines are no lines (they always stay). Rows without an id come before all others,
    each a document of its own, in an order by hashes of their texts. Of rows with one id the lines
    of one number are in an order by hashes of the texts too; such rows with one text are one document.
    ``max_edits`` 0 compares whole lines only.
    """
    need_columns("line_dedup", "id_col/text_col", docs, [id_col, text_col])
    kind = docs.schema[id_col].dataType
    near = F.when(F.col("near").isNotNull(), F.struct(_id(F.col("near.doc"), kind).alias("id"), F.col("near.line").alias("line")))
    return _kept(_named(docs, id_col, text_col), max_edits, min_words).select(_id(F.col("doc"), kind).alias("id"), "line", near.alias("near"))


def _judged(docs: DataFrame, id_col: str, text_col: str, max_edits: int, min_words: int, *more: Column) -> DataFrame:
    """``more`` of each row, and mine, gone, near: numbers of its lines, of those that go, and of the near ones among them."""
    named = _named(docs, id_col, text_col, F.col(id_col).isNull().alias("nameless"), *more)
    kept = _kept(named.select("doc", "t", "text"), max_edits, min_words)
    lines = [F.collect_list(F.when(c, F.col("line"))).alias(name) for c, name in ((F.col("near").isNull(), "kept"), (F.col("near").isNotNull(), "near"))]
    by_doc = kept.groupBy("doc", "t").agg(*lines)
    numbers = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.when(line.rlike(r"[^\x20\x09-\x0D]"), i))
    rows = named.withColumn("mine", F.array_compact(numbers)).drop("text")
    nameless, first = rows.where("nameless"), rows.where("not nameless")
    copies = None
    if not nameless.isEmpty():  # of those with one text the first has the lines; numbers stay as they are once written
        fixed = checkpoint(nameless.withColumn("uid", F.monotonically_increasing_id()))
        chosen = fixed.groupBy("doc", "t").agg(F.min("uid").alias("uid")).select("uid")
        copies = fixed.join(chosen, "uid", "left_anti").drop("uid")
        first = first.unionByName(fixed.join(chosen, "uid", "left_semi").drop("uid"))
    none = F.array().cast("array<int>")
    both = first.join(by_doc, ["doc", "t"], "left").withColumns({c: F.coalesce(c, none) for c in ("kept", "near")})
    if copies is not None:
        both = both.unionByName(copies.withColumns({"kept": none, "near": none}))
    gone = F.array_except("mine", "kept")
    return both.withColumns({"gone": F.array_sort(gone), "near": F.array_intersect(gone, "near")}).drop("doc", "t", "nameless", "kept")


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_words: int = 5) -> DataFrame:
    """``(id, n_lines, n_kept, n_exact, n_near, dropped)`` for each row of ``docs``.

    n_lines: lines with words; n_exact: those that came before word for word; n_near: first
    ones with an earlier near line; dropped: numbers of the lines that go, from 0 over all
    lines of the text, comma-joined. Of rows without an id and with one text, one has the lines.
    """
    need_columns("line_dedup", "id_col/text_col", docs, [id_col, text_col])
    rows = _judged(docs, id_col, text_col, max_edits, min_words, F.col(id_col).alias("id"))
    size = lambda c: F.size(c).cast("long")
    return rows.select("id", size("mine").alias("n_lines"), (size("mine") - size("gone")).alias("n_kept"), (size("gone") - size("near")).alias("n_exact"), size("near").alias("n_near"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("dropped"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = 1, min_words: int = 5) -> DataFrame:
    """``docs`` with the lines that go taken out of the text; all rows and columns stay, null stays null.

    Of rows without an id and with one text, one keeps the lines.
    """
    need_columns("line_dedup", "id_col/text_col", docs, [id_col, text_col])
    rows = _judged(docs, id_col, text_col, max_edits, min_words, F.struct(*[F.col(c).alias(f"d{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    text = f"row.d{docs.columns.index(text_col)}"
    left = F.expr(f"array_join(filter(transform(split({text}, '\\n'), (x, i) -> struct(x, i)), s -> not array_contains(gone, s.i)).x, '\n')")
    return rows.withColumn("left", F.when(F.size("gone") == 0, F.col(text)).otherwise(left)).select(*[F.col("left" if c == text_col else f"row.d{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS ord FROM lines WHERE len(w) > 0),
firsts AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min(ord) AS ord FROM numbered GROUP BY 1),
variants AS (
  SELECT ord, len(w) AS n, p, array_to_string(list_concat(w[1 : p - 1], w[p + 1 : len(w)]), ' ') AS k
  FROM (SELECT ord, w, unnest(range(1, len(w) + 1)) AS p FROM firsts WHERE len(w) >= 5)),
replaced AS (SELECT v.ord, min(m.ord) AS near FROM variants v JOIN variants m ON v.k = m.k AND v.n = m.n AND v.p = m.p AND m.ord < v.ord GROUP BY v.ord),
inserted AS (
  SELECT greatest(v.ord, f.ord) AS ord, min(least(v.ord, f.ord)) AS near
  FROM variants v JOIN firsts f ON v.k = f.s AND len(f.w) = v.n - 1 AND len(f.w) >= 5 GROUP BY 1),
near AS (SELECT DISTINCT ord FROM (SELECT ord FROM replaced UNION ALL SELECT ord FROM inserted)),
judged AS (SELECT n.doc_id, n.line, f.ord IS NULL AS exact, f.ord IS NOT NULL AND e.ord IS NOT NULL AS near FROM numbered n LEFT JOIN firsts f ON n.ord = f.ord LEFT JOIN near e ON n.ord = e.ord)
SELECT d.doc_id, count(j.line)::BIGINT AS n_lines, count(j.line) FILTER (NOT j.exact AND NOT j.near)::BIGINT AS n_kept, count(j.line) FILTER (j.exact)::BIGINT AS n_exact,
       count(j.line) FILTER (j.near)::BIGINT AS n_near, coalesce(string_agg(j.line::VARCHAR, ',' ORDER BY j.line) FILTER (j.exact OR j.near), '') AS dropped
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id
"""
