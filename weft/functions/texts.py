"""Text normalisation and tokens. All but Unicode normalisation are built-in expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: English stop words of the default token rule.
STOP_WORDS = ("the", "and", "for", "that", "with", "this", "are", "was", "not", "you", "but", "have", "from", "they", "his", "her", "had", "has", "were", "been", "will", "can", "its", "our", "your", "their", "there", "what", "when", "who", "which", "how", "all", "any", "one", "two", "also", "than", "then", "them", "these", "those", "into", "out", "about", "more", "some", "such", "only", "other", "over", "very", "just", "of", "to", "in", "is", "it", "on", "at", "by", "an", "be", "as", "or", "if", "so", "we", "he", "she", "me", "my", "do", "no", "up", "us", "am", "a", "i")

#: Names of emoticons, which stand in brackets; other words in brackets are text.
EMOTICONS = "微笑 大笑 偷笑 挤眼 酷 汗 泪 哭 哈哈 嘻嘻 可爱 爱你 花心 亲亲 允悲 喵喵 太开心 思考 嘘 并不简单 费解 疑问 汗颜 害怕 可怜 失望 怒 抓狂 晕 衰 骷髅 敲打 手心 胜利 握手 抱拳 勾引 拳头 差劲 干杯 礼物 蛋糕 蜡烛 炸弹 便便 咖啡 围脖 赞 鼓掌 心 伤心 围观 威武 钟 麦克风 沙漏 飞机 汽车 房子 月亮 太阳 星星 闪电 下雨 雪花 熊猫 兔子 猪头 公鸡 狗 猴子 老虎 牛 猫 章鱼 螃蟹 蜜蜂 玫瑰 凋谢 向日葵 树叶 大米 面包 啤酒 饮料 茶 苹果 香蕉 西瓜 草莓 樱桃 葡萄 桔子 柠檬".split()

#: What a repost adds to a text.
_INVISIBLE = r"[\x{200b}-\x{200d}\x{2060}\x{feff}\x{ad}\x{2066}-\x{2069}]"
_LINKS = r"(?:展开|收起)(?:[0-9A-Za-z]{1,3}|(?=$|\s))|L?微博视频[0-9A-Za-z]*|[Oo]?网页链接|https?://\S+|www\.\S+"
_NAME = r"@[^\s@:：,，。！？!?、；;/]{1,30}"
_REPLY = rf"\s*(?:回复)?\s*{_NAME}\s*[:：]\s*"
_CHAIN = rf"//\s*[^\s@:：]*\s*{_NAME}\s*[:：]\s*"
_RUN = r"(.)\1{2,}"
#: Texts that are held as Python's strings at a time.
TEXTS = 128


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode normalisation form KC, some texts at a time (Arrow's own function leaves characters decomposed)."""
    done = [pa.array([], pa.string())]
    for start in range(0, len(text), TEXTS):
        done.append(pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in text.slice(start, TEXTS).to_pylist()], pa.string()))
    return pa.concat_arrays(done)


def normalized(c: Column) -> Column:
    """What identifies a text: in one Unicode form, without links, emoticon codes, mentions, reply prefixes and quoted chains.

    A chain ``own words//@a: quoted//@b: quoted`` leaves the own words, or the last quoted ones
    where there are none but a reply prefix. Topics lose their marks, runs of a character keep two.
    """
    c = nfkc(F.regexp_replace(c, _INVISIBLE, ""))
    for pattern, to in (
        (rf"(?U){_LINKS}", " "),
        (rf"\[(?:[A-Za-z0-9_]{{1,16}}|{'|'.join(EMOTICONS)})\]", " "),
        (r"#([^#]{0,40})#", "$1"),
        (rf"(?Us)^\s*(?:{_REPLY})?{_CHAIN}(?:.*{_CHAIN})?", ""),
        (rf"(?Us){_CHAIN}.*$", ""),
        (rf"(?U)^{_REPLY}", ""),
        (rf"(?U){_NAME}[:：]?", " "),
        (_RUN, "$1$1"),
        (r"(?U)\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def normalized_key(c: Column) -> Column:
    """SHA-1 of the normalised text; empty if nothing is left."""
    return F.regexp_replace(F.sha1(normalized(c)), "^da39a3ee5e6b4b0d3255bfef95601890afd80709$", "")  # the SHA-1 of an empty text


def words(c: Column, lexicon=()) -> Column:
    """Words in lower case: runs of letters and digits; of Han characters the ``lexicon``'s words, longest first, and else each two neighbours (or a lone one).

    A ``Lexicon`` of the segment module, with what each word costs, cuts Han characters by the path of least cost instead.
    """
    if hasattr(lexicon, "cut"):
        return lexicon.words(c)
    plain, han = r"[\p{L}\p{N}&&[^\p{IsHan}]]++", r"\p{IsHan}"
    known = "|".join(rf"\Q{w.lower()}\E" for w in sorted(lexicon, key=lambda w: (-len(w), w)))
    if known:
        two, lone = f"{han}(?!{known}){han}", f"(?:(?<!{han})|(?<={known})){han}(?={known}|(?!{han}))"
    else:
        two, lone = f"{han}{han}", f"(?<!{han}){han}(?!{han})"
    first = f"{known}|" if known else ""
    cut = F.regexp_extract_all(F.lower(c), F.lit(f"(?=({first}{two}|{lone}|{plain}))(?:{first}{han}|{plain})"), F.lit(1))
    # below U+2E80 there are no Han characters, and nothing to look ahead for
    return cut if known else F.when(c.rlike(r"[\x{2e80}-\x{10ffff}]"), cut).otherwise(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9\p{L}\p{N}]++"), F.lit(0)))


def tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS, least: int = 2, lexicon=()) -> Column:
    """Words of two characters or more that are no bare number and no stop word."""
    return F.filter(words(c, lexicon), lambda w: (F.length(w) >= least) & ~w.rlike(r"^\p{N}+$") & (~w.isin(*stop) if stop else F.lit(True)))


def washed(c: Column) -> Column:
    """Social text as it reads: its first line up to a quoted chain, without links, controls of pages, reply prefixes, mentions, emoticon codes and contacts.

    Topics lose their marks, runs of a character keep two. Null if under 2 characters or without a letter or digit.
    """
    # fixed values: the patterns of what goes, in their order
    for pattern, to in (
        (r"[\x{200b}-\x{200f}\x{2028}\x{2029}\x{2060}\x{feff}]", ""),
        (r"(?U)https?://\S+|www\.\S+", " "),
        (r"O?网页链接|L微博视频|微博视频|查看图片", " "),
        (r"(?U)(?:展开|收起)(?:全文|[A-Za-z])?(?=$|[\s，。！？、,.!?;；:：~～|])", " "),
        (r"(?U)回复\s*@\S{1,30}?\s*[:：]", " "),
        (r"(?Us)//\s*@\S{1,30}?\s*[:：].*$", ""),
        (r"(?s)\n.*$", ""),
        (r"@[A-Za-z0-9_\-\x{4e00}-\x{9fa5}]{1,30}", " "),
        (r"#([^#\n]{1,40})#", "$1"),
        (r"\[[^\[\]\n]{1,10}\]", " "),
        (r"(?U)(?:[Vv]信|微信|QQ|qq|扣扣)\s*[:：]?\s*[A-Za-z0-9_\-]{4,20}|[1-9]\d{4,11}", " "),
        (_RUN, "$1$1"),
        (r"(?U)\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    # a lone character, or none that is a letter or digit, is taken off whole
    return F.nullif(F.regexp_replace(F.trim(c), r"(?s)^(?:.?|[^\p{L}\p{N}]*)$", ""), F.lit(""))


@F.arrow_udf(StringType())
def _decomposed(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKD")


def accent_key(c: Column) -> Column:
    """A key without case, accents, punctuation and runs of blanks."""
    plain = F.lower(F.regexp_replace(_decomposed(c), r"\p{M}+", ""))
    return F.trim(F.regexp_replace(plain, r"[^0-9a-z\x{4e00}-\x{9fff}]+", " "))
