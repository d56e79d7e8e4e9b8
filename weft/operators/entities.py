"""Named entities of Han text with their places, and of a gazetteer of one's own.

What entities end with, and what stands before places, is found by one automaton over all these words, which a worker builds
once; a run of Han characters is then looked at once, however long it is. A table function gives a row for each entity, and
a lateral join puts the rows beside those that the text came from.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from weft.errors import OpError, need_columns, need_one_of
from weft.runtime import ship

# fixed values: the words that families of entities are told by
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
HONORIFICS = "先生 女士 同志 教授 医生 老师 局长 主任 经理 总裁 董事长 主席 委员 部长 省长 市长 县长 书记".split()
ORG_ENDS = "大学 学院 医院 集团 公司 银行 协会 基金会 委员会 局 部 办 社 中心 研究院 研究所 厂".split()
LOC_CUES = "在 到 位于 来自".split()
LOC_ENDS = "省 市 县 区 镇 乡 村 路 街 大道 广场 湖 山 河".split()
LABELS = ("PERSON", "ORG", "LOC", "DATE")

#: Terms of a gazetteer that workers hold.
MOST_TERMS = 500_000
_HAN = "一-龥"
_RUN = re.compile(f"[{_HAN}]+")
_PERSON = re.compile(f"(?:[{_HAN}]{{2,4}}|[{SURNAMES}])(?:{'|'.join(HONORIFICS)})")
_DATE = re.compile(r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}年\d{1,2}月|\d{1,2}月\d{1,2}日")
#: Automata of this worker by what they hold.
_BUILT: dict[str, object] = {}


def _automaton(words: dict[str, object]):
    import ahocorasick

    key = hashlib.sha256(repr(sorted(words.items(), key=repr)).encode()).hexdigest()
    if key not in _BUILT:
        if len(_BUILT) > 8:
            _BUILT.clear()
        found = ahocorasick.Automaton()
        for word, value in words.items():
            found.add_word(word, (len(word), value))
        found.make_automaton()
        _BUILT[key] = found
    return _BUILT[key]


def _marks() -> dict[str, object]:
    """The words of organisations and places with what each is; a word can be several things."""
    out: dict[str, tuple] = {}
    for kind, words in (("org", ORG_ENDS), ("cue", LOC_CUES), ("loc", LOC_ENDS)):
        for order, word in enumerate(words):
            out[word] = (*out.get(word, ()), (kind, order))
    return out


def _last(ends: list[tuple[int, int, int]], least: int) -> int | None:
    """Where the entity ends that goes up to the last of ``ends`` (start, order, end) from ``least`` on; of those at one place the first by order."""
    fit = [e for e in ends if e[0] >= least]
    if not fit:
        return None
    top = max(e[0] for e in fit)
    return min((e[1], e[2]) for e in fit if e[0] == top)[1]


def find(text: str, types: tuple[str, ...] = LABELS) -> list[tuple[str, str, int, int]]:
    """``(text, label, start, end)`` of each entity, by label and place; places in characters, the end exclusive.

    A person is two to four characters, or one surname, and an honorific. An organisation is a run of Han characters up to
    the last of its words with two characters before it, a place the same behind a cue. Dates have years, months or days.
    """
    out = []
    if "PERSON" in types:
        out += [(m[0], "PERSON", m.start(), m.end()) for m in _PERSON.finditer(text)]
    if "ORG" in types or "LOC" in types:
        marks = _automaton(_marks())
        for run in _RUN.finditer(text):
            a = run.start()
            found = {"org": [], "cue": [], "loc": []}
            for last, (size, kinds) in marks.iter(run[0]):
                for kind, order in kinds:
                    found[kind].append((a + last + 1 - size, order, a + last + 1))
            if "ORG" in types and (end := _last(found["org"], a + 2)) is not None:
                out.append((text[a:end], "ORG", a, end))
            if "LOC" in types and found["loc"]:
                top = max(e[0] for e in found["loc"])
                start = next((e for _, _, e in sorted(found["cue"]) if e + 2 <= top), None)
                if start is not None:
                    end = _last(found["loc"], start + 2)
                    out.append((text[start:end], "LOC", start, end))
    if "DATE" in types:
        out += [(m[0], "DATE", m.start(), m.end()) for m in _DATE.finditer(text)]
    return sorted(out, key=lambda x: (LABELS.index(x[1]), x[2]))


def find_terms(text: str, terms: dict[str, str]) -> list[tuple[str, str, int, int]]:
    """``(text, label, start, end)`` of the terms of a gazetteer: the leftmost, of those at one place the longest, none within another."""
    out, at = [], 0
    found = sorted((last + 1 - size, -(last + 1), label) for last, (size, label) in _automaton(terms).iter(text)) if terms else []
    for start, minus, label in found:
        if start >= at:
            out.append((text[start:-minus], label, start, -minus))
            at = -minus
    return out


def entities(df: DataFrame, id_col: str, column: str, types: list[str] | None = None, gazetteer: DataFrame | None = None) -> DataFrame:
    """``(id, text, label, start, end)`` of the entities of the wanted types, and of the terms of a gazetteer ``(term, label)``.

    Places are in characters, the end exclusive. A row for each place, repeated rows repeat; null and blank texts give none.
    Of a term with several labels the first counts; terms are as they are written, up to ``MOST_TERMS``.
    """
    need_columns("entities", "columns", df, [id_col, column])
    for t in types or []:
        need_one_of("entities", "types", t, LABELS)
    try:
        import ahocorasick  # noqa: F401
    except ModuleNotFoundError:
        raise OpError("entities", "ahocorasick", "the package pyahocorasick is not installed") from None
    wanted, terms = tuple(types or LABELS), {}
    if gazetteer is not None:
        need_columns("entities", "gazetteer", gazetteer, ["term", "label"])
        rows = gazetteer.where("term <> '' and label is not null").groupBy("term").agg(F.min("label").alias("label")).limit(MOST_TERMS + 1).collect()
        if len(rows) > MOST_TERMS:
            raise OpError("entities", "gazetteer", f"over {MOST_TERMS} terms")
        terms = {r["term"]: r["label"] for r in rows}
    ship(df.sparkSession)

    @udtf(returnType="text string, label string, start int, end int")
    class Entities:
        def eval(self, text: str):
            if text:
                yield from find(text, wanted)
                yield from find_terms(text, terms)

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").cast("string").alias("__text"))
    return rows.lateralJoin(Entities(F.col("__text").outer())).select("id", "text", "label", "start", "end")
