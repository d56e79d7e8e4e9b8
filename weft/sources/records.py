"""Bibliographic exports as one table of records.

Tagged text is read with the record's end as line separator, so a large file splits into
many tasks and a row is a record; tags are taken apart by built-in functions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.errors import OpError
from weft.functions.scalars import year_of
from weft.runtime import ship

COLUMNS = ("title", "authors", "affiliations", "journal", "year", "volume", "issue", "pages", "keywords", "abstract", "references", "doi")

#: Fixed values of the export formats: the record's end, where an item starts, its tag, and the tags of each field.
TAGGED = {
    "ris": ("\nER  -", r"\n(?=[A-Z][A-Z0-9]  -)", r"^([A-Z][A-Z0-9])  - ?", {"title": ("TI", "T1"), "authors": ("AU", "A1"), "affiliations": ("AD",), "journal": ("JO", "T2", "JF"), "year": ("PY", "Y1"), "volume": ("VL",), "issue": ("IS",), "pages": ("SP", "EP"), "keywords": ("KW",), "abstract": ("AB", "N2"), "references": ("CR",), "doi": ("DO",)}),
    "wos": ("\nER\n", r"\n(?=[A-Z][A-Z0-9] )", r"^([A-Z][A-Z0-9]) ", {"title": ("TI",), "authors": ("AU", "AF"), "affiliations": ("C1",), "journal": ("SO",), "year": ("PY",), "volume": ("VL",), "issue": ("IS",), "pages": ("BP", "EP"), "keywords": ("DE", "ID"), "abstract": ("AB",), "references": ("CR",), "doi": ("DI",)}),
    "pubmed": ("\n\n", r"\n(?=[A-Z]{2,4} *- )", r"^([A-Z]{2,4}) *- ", {"title": ("TI",), "authors": ("FAU", "AU"), "affiliations": ("AD",), "journal": ("JT", "TA"), "year": ("DP",), "volume": ("VI",), "issue": ("IP",), "pages": ("PG",), "keywords": ("OT", "MH"), "abstract": ("AB",), "references": (), "doi": ("LID", "AID")}),
    "refworks": ("\n\n", r"\n(?=[A-Z][A-Z0-9] )", r"^([A-Z][A-Z0-9]) ", {"title": ("T1",), "authors": ("A1",), "affiliations": ("AD",), "journal": ("JF",), "year": ("YR",), "volume": ("VO",), "issue": ("IS",), "pages": ("OP", "SP"), "keywords": ("K1",), "abstract": ("AB",), "references": ("CR",), "doi": ("DO",)}),
    "endnote": ("\n\n", r"\n(?=%[0-9A-Z@] )", r"^%([0-9A-Z@]) ", {"title": ("T",), "authors": ("A",), "affiliations": ("+",), "journal": ("J", "B"), "year": ("D",), "volume": ("V",), "issue": ("N",), "pages": ("P",), "keywords": ("K",), "abstract": ("X",), "references": (), "doi": ("R",)}),
    "cssci": ("\n\n", r"\n(?=【)", r"^【([^】]{1,20})】", {"title": ("来源篇名", "篇名", "题名"), "authors": ("来源作者", "作者"), "affiliations": ("机构", "作者机构"), "journal": ("期刊", "来源期刊"), "year": ("年代卷期", "年代"), "volume": ("卷",), "issue": ("期",), "pages": ("页码",), "keywords": ("关键词",), "abstract": ("摘要",), "references": ("参考文献",), "doi": ("DOI",)}),
    "noteexpress": ("\n\n", r"\n(?=\{[A-Za-z ]+\}:)", r"^\{([^}]+)\}:", {"title": ("Title",), "authors": ("Author",), "affiliations": ("Author Address",), "journal": ("Journal",), "year": ("Year",), "volume": ("Volume",), "issue": ("Issue",), "pages": ("Pages",), "keywords": ("Keywords",), "abstract": ("Abstract",), "references": ("References",), "doi": ("DOI",)}),
}
#: Headings of the table exports by field.
TABLES = {
    "scopus": {"title": ("Title", "文献标题"), "authors": ("Authors", "作者"), "affiliations": ("Affiliations", "归属机构"), "journal": ("Source title", "来源出版物名称"), "year": ("Year", "年份"), "volume": ("Volume", "卷"), "issue": ("Issue", "期"), "pages": ("Page start", "起始页码"), "keywords": ("Author Keywords", "作者关键字"), "abstract": ("Abstract", "摘要"), "references": ("References", "参考文献"), "doi": ("DOI",)},
    "dimensions": {"title": ("Title",), "authors": ("Authors",), "affiliations": ("Authors Affiliations", "Authors (Raw Affiliation)"), "journal": ("Source title",), "year": ("PubYear",), "volume": ("Volume",), "issue": ("Issue",), "pages": ("Pagination",), "keywords": ("MeSH terms",), "abstract": ("Abstract",), "references": ("Cited references",), "doi": ("DOI",)},
    "lens": {"title": ("Title",), "authors": ("Author/s",), "affiliations": ("Institutions",), "journal": ("Source Title",), "year": ("Publication Year",), "volume": ("Volume",), "issue": ("Issue Number",), "pages": ("Start Page",), "keywords": ("Keywords",), "abstract": ("Abstract",), "references": ("References",), "doi": ("DOI",)},
    "pubmed_csv": {"title": ("Title",), "authors": ("Authors",), "affiliations": (), "journal": ("Journal/Book",), "year": ("Publication Year",), "volume": (), "issue": (), "pages": (), "keywords": (), "abstract": (), "references": (), "doi": ("DOI",)},
    "wos_table": {"title": ("TI", "Article Title"), "authors": ("AU", "Authors"), "affiliations": ("C1", "Addresses"), "journal": ("SO", "Source Title"), "year": ("PY", "Publication Year"), "volume": ("VL", "Volume"), "issue": ("IS", "Issue"), "pages": ("BP", "Start Page"), "keywords": ("DE", "Author Keywords"), "abstract": ("AB", "Abstract"), "references": ("CR", "Cited References"), "doi": ("DI", "DOI")},
}
_LISTS = ("authors", "affiliations", "keywords", "references")


def _finished(rows: DataFrame, fmt: str, fields: dict[str, Column]) -> DataFrame:
    doi = F.regexp_extract(F.coalesce(fields["doi"], F.lit("")), r"(10\.\d{4,9}/[^\s;\"\]]+)", 1)
    out = rows.select(*[(year_of(c) if n == "year" else doi if n == "doi" else c).alias(n) for n, c in fields.items()])
    out = out.where("title is not null and title <> ''").withColumn("format", F.lit(fmt))
    return out.withColumn("record_id", F.substring(F.sha1(F.concat_ws("\u001e", "title", "authors", F.col("year").cast("string"), "journal")), 1, 16)).select("record_id", *COLUMNS, "format")


def read_tagged(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Records of a tagged text export; those without a title are left out."""
    if fmt not in TAGGED:
        raise OpError("read_tagged", "fmt", f"{fmt!r} is not one of {', '.join(TAGGED)}")
    end, item, tag, fields = TAGGED[fmt]
    rows = spark.read.text(path, lineSep=end).select(F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")).alias("r"))
    many = fmt == "wos"
    pairs = F.transform(F.split("r", item), lambda s: F.struct(F.regexp_extract(F.ltrim(s), tag, 1).alias("tag"), F.regexp_replace(F.ltrim(s), tag, "").alias("value")))
    rows = rows.select(F.filter(pairs, lambda p: p["tag"] != "").alias("p"))

    def values(name: str, tags: tuple[str, ...]) -> Column:
        lists = []
        for t in tags:
            found = F.transform(F.filter("p", lambda p: p["tag"] == t), lambda p: p["value"])  # noqa: B023
            if many and name in _LISTS and name != "keywords":
                found = F.flatten(F.transform(found, lambda v: F.split(v, r"\n\s+")))
            lists.append(F.filter(F.transform(found, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != ""))
        if not lists:
            return F.lit(None).cast("string")
        if name == "pages" and len(lists) > 1:
            return F.array_join(F.concat(F.slice(lists[0], 1, 1), F.slice(lists[1], 1, 1)), "-")
        best = lists[0]
        for more in lists[1:]:
            best = F.when(F.size(best) > 0, best).otherwise(more)
        return F.nullif(F.array_join(best, ";"), F.lit("")) if name in _LISTS else F.try_element_at(best, F.lit(1))

    return _finished(rows, fmt, {n: values(n, fields[n]) for n in COLUMNS})


_NAME = re.compile(r"[\s,]*([A-Za-z][\w:.+-]*)\s*=\s*")
_BRACE, _QUOTE_END, _BARE, _JOIN = re.compile(r"[{}]"), re.compile(r'[{}"]'), re.compile(r"[^\s,{}#\"]+"), re.compile(r"\s*#\s*")


def _closing(text: str, at: int, quoted: bool) -> int:
    """Where the value that starts at ``at`` ends: at its closing brace, or at a quotation mark outside of braces; -1 without one."""
    open_ = 0 if quoted else 1
    for m in (_QUOTE_END if quoted else _BRACE).finditer(text, at):
        if m[0] == '"':
            if not open_:
                return m.start()
        else:
            open_ += 1 if m[0] == "{" else -1
            if not open_ and not quoted:
                return m.start()
            if open_ < 0:
                return -1
    return -1


def bibtex_fields(entry: str) -> tuple[dict[str, str], str | None]:
    """The fields of an entry by name in lower case, the first of each, and the name of a field that does not end.

    Values are in braces of any depth, in quotation marks or bare numbers, and may be joined by ``#``; one that does not end
    is left out, and what follows it with it.
    """
    out: dict[str, str] = {}
    at = entry.find("{") + 1
    comma = entry.find(",", at) if at else -1
    at = comma if comma >= 0 else len(entry)
    while m := _NAME.match(entry, at):
        at, parts = m.end(), []
        while True:
            sign = entry[at : at + 1]
            if sign in ("{", '"') and sign:
                end = _closing(entry, at + 1, sign == '"')
                if end < 0:
                    return out, m[1].lower()
                parts.append(entry[at + 1 : end])
                at = end + 1
            elif bare := _BARE.match(entry, at):
                parts.append(bare[0] if bare[0].isdigit() else "")
                at = bare.end()
            else:
                break
            if not (join := _JOIN.match(entry, at)):
                break
            at = join.end()
        out.setdefault(m[1].lower(), "".join(parts))
    return out, None


def _bibtex_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(head, fields, unended)`` of each entry of a BibTeX file."""
    ship(spark)
    rows = spark.read.text(path, lineSep="\n@").select(F.regexp_replace("value", "\r", "").alias("r")).where(r"r rlike '(?s)^\\s*@?\\s*[A-Za-z]+\\s*\\{'")

    def run(batches):
        for batch in batches:
            found = [(e.split("\n", 1)[0][:200], *bibtex_fields(e)) for e in batch.column(0).to_pylist()]
            columns = [pa.array([h for h, _, _ in found], pa.string()), pa.array([list(f.items()) for _, f, _ in found], pa.map_(pa.string(), pa.string())), pa.array([u for _, _, u in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["head", "fields", "unended"])

    return rows.mapInArrow(run, "head string, fields map<string,string>, unended string")


def bibtex_problems(spark: SparkSession, path: str) -> DataFrame:
    """``(head, field)``: the first line of each entry with a value that does not end, and the name of that field."""
    return _bibtex_rows(spark, path).where("unended is not null").select("head", F.col("unended").alias("field"))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Records of a BibTeX file; values in braces of any depth, quotation marks or bare numbers.

    Of an entry with a value that does not end the fields before it count; ``bibtex_problems`` names such entries.
    """
    rows = _bibtex_rows(spark, path)

    def value(name: str) -> Column:
        text = F.try_element_at("fields", F.lit(name))
        return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, r"[{}]", ""), r"\s+", " ")), F.lit(""))

    names = {"title": "title", "authors": "author", "affiliations": "affiliation", "journal": "journal", "year": "year", "volume": "volume", "issue": "number", "pages": "pages", "keywords": "keywords", "abstract": "abstract", "references": "cited-references", "doi": "doi"}
    fields = {n: value(names[n]) for n in COLUMNS}
    fields["journal"] = F.coalesce(fields["journal"], value("booktitle"))
    fields["authors"] = F.regexp_replace(fields["authors"], r"\s+and\s+", ";")
    fields["keywords"] = F.regexp_replace(fields["keywords"], r"\s*[,;]\s*", ";")
    return _finished(rows, "bibtex", fields)


def read_record_table(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Records of a CSV export (tab-separated for ``wos_table``); headings may be in either language."""
    if fmt not in TABLES:
        raise OpError("read_record_table", "fmt", f"{fmt!r} is not one of {', '.join(TABLES)}")
    head = [r[0].lstrip("\ufeff") for r in spark.read.text(path).limit(2).collect()]
    if fmt == "dimensions" and len(head) > 1 and "PubYear" not in head[0]:  # a banner line stands before the headings
        names = csv_line(head[1])
        rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, multiLine=True, escape='"')
        rows = rows.where(F.col(f"`{names[1]}`").isNotNull() & (F.col(f"`{names[1]}`") != names[1]))
    else:
        rows = spark.read.csv(path, header=True, sep="\t" if fmt == "wos_table" else ",", multiLine=True, escape='"')
    have = {c.lstrip("\ufeff").strip().lower(): c for c in rows.columns}
    fields = {}
    for n in COLUMNS:
        found = [F.nullif(F.trim(F.col(f"`{have[h.lower()]}`")), F.lit("")) for h in TABLES[fmt][n] if h.lower() in have]
        cell = F.coalesce(*found) if found else F.lit(None).cast("string")
        fields[n] = F.regexp_replace(cell, r"\s*;\s*", ";") if n in _LISTS else cell
    return _finished(rows, fmt, fields)


def csv_line(line: str) -> list[str]:
    import csv

    return [c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]))]


def detect_format(spark: SparkSession, path: str) -> str:
    """The export format by the first lines of a file, or an empty text."""
    lines = [r[0].lstrip("\ufeff") for r in spark.read.text(path).limit(40).collect()]
    text = "\n".join(lines)
    starts = lambda *marks: any(line.startswith(marks) for line in lines)
    if starts("TY  - "):
        return "ris"
    if starts("PMID- "):
        return "pubmed"
    if starts("FN ", "PT "):
        return "wos"
    if starts("RT "):
        return "refworks"
    if starts("%0 "):
        return "endnote"
    if starts("【"):
        return "cssci"
    if starts("{Reference Type}"):
        return "noteexpress"
    if starts("@"):
        return "bibtex"
    if "PubYear" in text:
        return "dimensions"
    if "Lens ID" in text or "Author/s" in text:
        return "lens"
    if "Journal/Book" in text:
        return "pubmed_csv"
    if "Source title" in text or "来源出版物名称" in text:
        return "scopus"
    return "wos_table" if lines and {"PT", "AU", "TI"} <= set(lines[0].split("\t")) else ""


def read_records(spark: SparkSession, path: str, fmt: str = "") -> DataFrame:
    """The records of an export in any of the formats; ``record_id`` is a hash of title, authors, year and journal."""
    fmt = fmt or detect_format(spark, path)
    if fmt == "bibtex":
        return read_bibtex(spark, path)
    if fmt in TAGGED:
        return read_tagged(spark, path, fmt)
    if fmt in TABLES:
        return read_record_table(spark, path, fmt)
    raise OpError("read_records", "fmt", f"{path}: no known export format")


def parse_reference(c: Column) -> Column:
    """A struct ``author, year, title, journal, doi`` of one cited reference in a comma-, full-stop- or bracket-separated style."""
    text = F.trim(F.regexp_replace(c, r"^\s*(\[\d+\]|\d+[.、\]])\s*", ""))
    year = year_of(text)
    doi = F.nullif(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s,;\]]+)", 1), F.lit(""))
    commas = text.rlike(r"^[^,]{2,40}, (1[89]|20)\d{2}, ")
    author = F.trim(F.when(commas, F.regexp_extract(text, r"^([^,]+),", 1)).otherwise(F.regexp_extract(text, r"^([^.．]+)[.．]", 1)))
    title = F.when(commas, F.lit(None)).otherwise(F.trim(F.regexp_extract(text, r"^[^.．]+[.．]\s*([^.．\[]+)", 1)))
    journal = F.when(commas, F.regexp_extract(text, r"^[^,]+, \d{4}, ([^,]+)", 1)).otherwise(F.regexp_extract(text, r"(?:\[J\]|[.．])\s*([^.．,，\[\]]+)[,，]\s*(?:1[89]|20)\d{2}", 1))
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.struct(blank(author).alias("author"), year.alias("year"), blank(title).alias("title"), blank(journal).alias("journal"), doi.alias("doi"))


def references(records: DataFrame) -> DataFrame:
    """``(record_id, position, reference, author, year, title, journal, doi)``, a row for each cited reference."""
    rows = records.where("`references` is not null").select("record_id", F.posexplode(F.split("references", ";")).alias("position", "reference")).where("trim(reference) <> ''")
    return rows.select("record_id", "position", F.trim("reference").alias("reference"), parse_reference(F.col("reference")).alias("x")).select("record_id", "position", "reference", "x.*")


def open_upload(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """A file of any kind: the records of a bibliographic export if it is one, else the table that its ending names."""
    from weft.sources.tables import read_table

    end = path.rstrip("/").rpartition(".")[2].lower()
    if end not in ("parquet", "json", "jsonl", "xls", "xlsx") and (fmt := detect_format(spark, path)):
        return read_records(spark, path, fmt)
    return read_table(spark, path, encoding=encoding if end in ("csv", "tsv") else "UTF-8")
