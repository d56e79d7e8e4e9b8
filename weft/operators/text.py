"""Text steps: word counts, TF-IDF, co-occurrence, keywords, washing and lexicon scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.errors import OpError, need_columns, need_one_of, need_positive
from weft.functions.scalars import strip
from weft.functions.texts import STOP_WORDS, tokens, washed
from weft.operators import blocks as B
from weft.operators.segment import learned
from weft.operators.skew import join_table
from weft.runtime import checkpoint


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _words(df: DataFrame, column: str, stop: tuple[str, ...], lexicon) -> Column:
    """The tokens of a column; ``lexicon`` is a list of Han words, a ``Lexicon``, or ``learned`` for the one that the column gives by itself."""
    need_columns("words", "column", df, [column])
    if lexicon == "learned":
        lexicon = learned(df, column)
    return tokens(_col(column), stop, lexicon=lexicon)


def word_counts(df: DataFrame, column: str, top_n: int = 120, mode: str = "word_freq", stop: tuple[str, ...] = STOP_WORDS, lexicon=()) -> DataFrame:
    """The ``top_n`` words: with counts (``word_freq``), alone (``words_only``) or as one line (``csv_line``).

    ``lexicon`` says what words Han text has: a list, a ``Lexicon``, or ``learned``.
    """
    need_columns("word_counts", "column", df, [column])
    need_one_of("word_counts", "mode", mode, ("word_freq", "words_only", "csv_line"))
    need_positive("word_counts", "top_n", top_n)
    out = df.select(F.explode(_words(df, column, stop, lexicon)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency")).orderBy(F.desc("frequency"), "word").limit(top_n)
    if mode == "words_only":
        return out.select("word")
    if mode == "csv_line":
        line = F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "word")))
        return out.agg(F.array_join(line["word"], ",").alias("line"))
    return out


def tf_idf(df: DataFrame, id_col: str, column: str, stop: tuple[str, ...] = STOP_WORDS, lexicon=(), idf: DataFrame | None = None) -> DataFrame:
    """``(id, word, tf, weight)``: tf times ``ln((1 + n) / (1 + df)) + 1``, each text scaled to length 1. n counts texts with words.

    Texts are split once and their counts written once; a common word's rows are dealt out to meet its figure. With ``idf``,
    a table ``(word, idf)`` with one row a word, its figures count instead, and of words that it does not have the median of them.
    """
    need_columns("tf_idf", "columns", df, [id_col, column])
    words = _words(df, column, stop, lexicon)
    tf = checkpoint(df.select(_col(id_col).alias("id"), F.explode(words).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf")))
    by_word = checkpoint(tf.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    size = by_word.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if idf is None:
        n = tf.select("id").distinct().count()
        table = by_word.select("word", (F.log((1 + F.lit(n)) / (1 + F.col("n"))) + 1).alias("idf"))
    else:
        need_columns("tf_idf", "idf", idf, ["word", "idf"])
        usual = idf.agg(F.percentile("idf", 0.5)).first()[0]
        table = by_word.join(idf.groupBy("word").agg(F.max("idf").alias("idf")), "word", "left").select("word", F.coalesce("idf", F.lit(usual), F.lit(1.0)).cast("double").alias("idf"))
    raw = join_table(tf, table, "word", by_word, size["words"], size["rows"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))  # the distinct words of a text
    return raw.select("id", "word", "tf", F.try_divide(F.col("raw"), norm).alias("weight"))


def keywords(df: DataFrame, id_col: str, column: str, top_k: int = 10, per_row: bool = False, stop: tuple[str, ...] = STOP_WORDS, lexicon=(), idf: DataFrame | None = None) -> DataFrame:
    """Words by the sum of their TF-IDF weights, or the ``top_k`` of each text; ``lexicon`` and ``idf`` as in ``tf_idf``."""
    need_columns("keywords", "columns", df, [id_col, column])
    if not per_row and idf is None and df.groupBy(_col(id_col)).count().where("count > 1").isEmpty():
        weights = _weight_sums(B.encoded(df, _words(df, column, stop, lexicon), 1))
        return weights.orderBy(F.desc("weight"), "word").limit(top_k)
    weights = tf_idf(df, id_col, column, stop, lexicon, idf)  # rows of one id are one text
    if not per_row:
        return weights.groupBy("word").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "word").limit(top_k)
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "word")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("id", "rank", "word", "weight")


def _weight_sums(blocks: DataFrame) -> DataFrame:
    """``(word, weight)``: the sums of the weights that ``tf_idf`` gives, from blocks of texts."""
    n = B.texts_with_words(blocks)
    table = B.text_counts(blocks).select("word", (F.log((1 + F.lit(n)) / (1 + F.col("n"))) + 1).alias("idf"))
    return B.weight_sums(blocks, table)


def cooccurrence(df: DataFrame, id_col: str, column: str, topn: int = 30, min_count: int = 2, window: int = 0, stop: tuple[str, ...] = STOP_WORDS, lexicon=()) -> DataFrame:
    """``(a, b, count)`` of the ``topn`` (up to 120) heaviest words: texts with both, or with a window the word windows with both.

    At most ``topn`` words take part, so a text gives at most ``topn`` squared pairs whatever its length.
    """
    need_columns("cooccurrence", "columns", df, [id_col, column])
    if not 2 <= topn <= 120:
        raise OpError("cooccurrence", "topn", f"{topn} is not from 2 to 120")
    if lexicon == "learned":
        lexicon = learned(df, column)
    blocks = B.encoded(df, _words(df, column, stop, lexicon), max(window - 1, 1))
    if df.groupBy(_col(id_col)).count().where("count > 1").isEmpty():
        best = _weight_sums(blocks).orderBy(F.desc("weight"), "word").limit(topn)
    else:
        best = keywords(df, id_col, column, topn, stop=stop, lexicon=lexicon)
    chosen = [r["word"] for r in best.collect()]  # at most 120 words
    return B.meetings(blocks, chosen, window).where(F.col("count") >= min_count).orderBy(F.desc("count"), "a", "b")


def wash(df: DataFrame, column: str) -> DataFrame:
    """``cleaned_text`` and ``action`` (``keep``, or ``drop`` where nothing readable is left)."""
    need_columns("wash", "column", df, [column])
    clean = washed(_col(column))
    return df.withColumn("cleaned_text", F.coalesce(clean, F.lit(""))).withColumn("action", F.when(clean.isNull(), "drop").otherwise("keep"))


#: Families of hostile wording as they are looked for, and what each weighs.
FAMILIES = {
    "abuse": (
        0.45,
        r"傻[逼比逼叉]|滚[开蛋]?|去死|废物|垃圾|贱[人货]|狗东西|王八|畜生|婊子|荡妇|脑残|智障|弱智|神经病"
        r"|死全家|断子绝孙|不得好死|早死|怎么不去死|活着浪费|去投胎"
        r"|[\x{4e00}-\x{9fa5}]{0,4}玩意|不要脸|无耻|下贱|恶心透|令人作呕",
    ),
    "attack": (
        0.3,
        r"(?:你|他|她|它|这|那)[们]?算(?:什么|哪个|哪门子)"
        r"|有脸|也配|不配|配(?:上|做|当|得上|不上)|什么(?:学历|出身)|生个[孩子]|基因(?:有问题|缺陷)"
        r"|(?:一家|全家|父母|爹妈|母亲|父亲|家人)(?:都|全)?(?:是|有|没|活该|该死)"
        r"|(?:活该|该|早就该)(?:死|凉|滚|被封|被骂)|自作自受|不是人",
    ),
    "privacy": (
        0.6,
        r"1[3-9]\d{9}"
        r"|\d{17}[\dXx]|\d{15}"
        r"|\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
        r"|[\x{4e00}-\x{9fa5}]{2,8}(?:省|市|县|区)[\x{4e00}-\x{9fa5}]{0,10}(?:路|街|街道|巷|大道|新村|花园|小区)[\d零一二三四五六七八九十百]{0,6}(?:号|号楼)?"
        r"|\d{1,4}(?:号楼|号院|栋|幢|单元|门牌)[\d室]{0,5}"
        r"|人肉(?:搜索)?|扒(?:了)?(?:出来|出?来|光)|开盒|曝光(?:其|他的|她的)?(?:信息|住址|单位|学校|电话|身份)"
        r"|(?:家庭住址|工作单位|就职|学籍|学校(?:是|在)|身份证(?:号)?|手机号?(?:码)?|户籍)(?:在|是|为|[:：])",
    ),
    "rumour": (
        0.2,
        r"听说|据(?:说|传)|内部(?:消息|人)(?:说|透露)?|朋友(?:说|告诉我)|我认识(?:的)?(?:他|她|他们|家属)"
        r"|被(?:安排|利用|当枪)|幕后(?:黑手|推手)|拿了(?:钱|好处)|收(?:了)?(?:钱|黑钱)"
        r"|(?:真相|内幕)(?:是|其实)|其实(?:他|她|他们)(?:根本|并|早就)",
    ),
}
#: What each further term of a family adds, how much at most; the share of the second family; the levels.
REPEAT_STEP, REPEAT_CAP, SECOND_SHARE, SEVERE_AT, MILD_AT = 0.1, 0.2, 0.5, 0.5, 0.25


def aggression(df: DataFrame, column: str, families: dict[str, tuple[float, str]] | None = None) -> DataFrame:
    """``aggression`` (``severe``, ``mild``, ``none``), ``aggression_score`` and ``aggression_hits`` from word families.

    A family found weighs its figure and a little more for each further distinct term; the
    heaviest counts whole and the next by half. Hits are ``family:term、term``, the heaviest
    first. Null and blank cells are ``none``.
    """
    need_columns("aggression", "column", df, [column])
    families = families or FAMILIES
    body = F.coalesce(_col(column).cast("string"), F.lit(""))
    fired = []
    for order, (name, (weight, pattern)) in enumerate(families.items()):
        found = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(body, F.lit(f"(?U){pattern}"), F.lit(0)), lambda x: strip(x)), lambda x: x != ""))
        fired.append(F.struct(F.lit(weight).cast("double").alias("base"), F.lit(order).alias("order"), F.lit(name).alias("family"), found.alias("found")))
    rows = df.withColumn("__fired", F.filter(F.array(*fired), lambda x: F.size(x["found"]) > 0))
    weighed = F.transform("__fired", lambda x: F.struct((-x["base"] - F.least(F.lit(REPEAT_CAP), REPEAT_STEP * (F.size(x["found"]) - 1))).alias("minus"), x["order"].alias("order"), F.concat(x["family"], F.lit(":"), F.array_join(x["found"], "、")).alias("hit")))
    rows = rows.withColumn("__fired", F.array_sort(weighed))
    exact = -F.coalesce(F.get("__fired", F.lit(0))["minus"], F.lit(0.0)) - SECOND_SHARE * F.coalesce(F.get("__fired", F.lit(1))["minus"], F.lit(0.0))
    rows = rows.withColumn("aggression_score", exact)
    level = F.when(F.col("aggression_score") >= SEVERE_AT, "severe").when(F.col("aggression_score") >= MILD_AT, "mild").otherwise("none")
    rows = rows.withColumn("aggression", level).withColumn("aggression_score", F.round(F.col("aggression_score"), 4) + 0.0)
    return rows.withColumn("aggression_hits", F.array_join(F.transform("__fired", lambda x: x["hit"]), "；")).drop("__fired")


def text_rank(df: DataFrame, column: str, top_k: int = 10, span: int = 5, rounds: int = 10, damping: float = 0.85, stop: tuple[str, ...] = STOP_WORDS, lexicon=()) -> DataFrame:
    """``(word, score)`` by PageRank over words that stand within ``span`` words of each other."""
    need_columns("text_rank", "column", df, [column])
    blocks = B.encoded(df, _words(df, column, stop, lexicon), max(span - 1, 1))
    ranks = B.neighbour_ranks(blocks, span, rounds, damping)
    return ranks.select("word", F.col("pagerank").alias("score")).orderBy(F.desc("score"), "word").limit(top_k)
