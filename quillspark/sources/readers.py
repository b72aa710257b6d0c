"""Sources and sinks: JSON lines, manifests, CSV tables, raw bytes, HTML pages, recorded responses, hash-keyed stores."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.session import shared_dir


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the read (strict) or is dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest(rows: DataFrame, fetched: DataFrame) -> DataFrame:
    """Included manifest rows (doc_id, include, accessed_at, ...) with their fetch time where the manifest has none."""
    times = fetched.groupBy("doc_id").agg(F.max("accessed_at").alias("_fetched"))
    return rows.where("include").join(times, "doc_id", "left").withColumn("accessed_at", F.coalesce("accessed_at", "_fetched")).drop("_fetched")


def csv_rows(spark: SparkSession, path: str, cell: int = 500) -> DataFrame:
    """(row_no, text): rows of a CSV file as "name：value；..." by the header; blank cells skipped, cells cut to `cell` characters."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    parts = [F.when(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != "", F.concat(F.lit(f"{c}："), F.left(F.trim(F.col(f"`{c}`")), F.lit(cell)))) for c in df.columns]
    return df.select(F.monotonically_increasing_id().alias("row_no"), F.concat_ws("；", *parts).alias("text"))


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w-]+)", re.I)


def _common_share(raw: bytes, low: int, high: int) -> float:
    """Share of two-byte characters whose lead byte lies in the rows of frequent characters of an encoding."""
    lead = total = i = 0
    while i < len(raw):
        if raw[i] < 0x81:
            i += 1
            continue
        total += 1
        lead += low <= raw[i] <= high
        i += 2
    return lead / total if total else 0.0


def detected(raw: bytes) -> list[str]:
    """utf-8, then gb18030 and big5, the one first in whose frequent rows more characters fall (GB 2312: B0-D7, Big5: A4-C6, with trail bytes below A1 that GB 2312 lacks)."""
    trail = sum(raw[i] >= 0xA1 and 0x40 <= raw[i + 1] < 0x7F for i in range(len(raw) - 1)) if len(raw) < 1 << 20 else 0
    chinese = _common_share(raw, 0xA4, 0xC6) if trail else 0.0
    return ["utf-8", "big5", "gb18030"] if chinese > 0.8 and chinese > _common_share(raw, 0xB0, 0xD7) else ["utf-8", "gb18030", "big5"]


def decode_bytes(raw: bytes, declared: str | None = None) -> tuple[str, str, str]:
    """(text, encoding, source): the declared character set, else one named in the first 4 KB, with replacement (declared); else the first detected one that
    decodes strictly (detected); else utf-8 with replacement (fallback). An unknown declared name counts as none."""
    named = declared or ((m := _CHARSET.search(raw[:4096])) and m[1].decode("ascii", "ignore")) or None
    if named:
        enc = named.strip().lower()
        enc = {"gbk": "gb18030", "gb2312": "gb18030", "utf8": "utf-8"}.get(enc, enc)
        try:
            return raw.decode(enc, "replace"), enc, "declared"
        except LookupError:
            pass
    for enc in detected(raw):
        try:
            return raw.decode(enc), enc, "detected"
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8", "fallback"


def decoded(files: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """(path, text, encoding, source) of a table of raw bytes (as from the binaryFile source), with a column of declared character sets if there is one."""

    def run(batches):
        for b in batches:
            named = b[declared] if declared else [None] * len(b)
            got = [(None, None, None) if x is None else decode_bytes(bytes(x), n) for x, n in zip(b[content], named, strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": [g[0] for g in got], "encoding": [g[1] for g in got], "source": [g[2] for g in got]})

    return files.select("path", content, *([declared] if declared else [])).mapInPandas(run, "path string, text string, encoding string, source string")


_SKIP = {"script", "style", "nav", "footer", "noscript", "template"}
_HEAD = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}
_BREAK = {"p", "div", "section", "article", "li", "tr", "br", "ul", "ol", "table", "h1", "h2", "h3", "h4", "blockquote"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


@dataclass(frozen=True)
class PageRules:
    """What of a page counts: containers of the content (by id, else by class, else the whole page) and what is left out inside. A rule of five characters or more also fits as part of a name."""

    content_ids: frozenset[str] = frozenset()
    content_classes: frozenset[str] = frozenset()
    skip_classes: frozenset[str] = frozenset()
    skip_ids: frozenset[str] = frozenset()

    def skips(self, attrs: dict[str, str]) -> bool:
        def fits(rules, value):
            return any(r in value.split() or len(r) >= 5 and r in value for r in rules)

        return fits(self.skip_classes, attrs.get("class", "")) or fits(self.skip_ids, attrs.get("id", ""))

    def is_content(self, attrs: dict[str, str], by: str) -> bool:
        return attrs.get("id", "") in self.content_ids if by == "id" else bool(set(attrs.get("class", "").split()) & self.content_classes)


class _Scout(HTMLParser):
    """Finds out by what the content of a page is told: id, class, or nothing."""

    def __init__(self, rules: PageRules) -> None:
        super().__init__()
        self.rules, self.seen = rules, set()

    def handle_starttag(self, tag, attrs):
        d = {k: v or "" for k, v in attrs}
        self.seen |= {by for by in ("id", "class") if self.rules.is_content(d, by)}


class _Page(HTMLParser):
    """Headings, paragraphs, list items and table rows of a page, in order; navigation, scripts, footers and what the rules skip are left out.

    A paragraph that is bold throughout is a heading of level 2. The first row of a table, or its head cells, name the columns."""

    def __init__(self, rules: PageRules | None = None, by: str | None = None) -> None:
        super().__init__()
        self.rules, self.by = rules or PageRules(), by
        self.out: list[tuple[str, int, str]] = []
        self.buffer, self.kind, self.level = [], "paragraph", 0
        self.open: list[tuple[str, bool, bool]] = []  # tag, skipped, content
        self.cells: list[str] | None = None
        self.header: list[str] = []
        self.title, self.bold, self.plain = "", 0, False

    @property
    def counted(self) -> bool:
        return not any(s for _, s, _ in self.open) and (self.by is None or any(c for *_, c in self.open))

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        strong = bool(text) and not self.plain
        self.buffer, self.plain = [], False
        if self.cells is not None:
            if text:
                self.cells.append(text)
        elif text and strong and self.kind == "paragraph" and len(text) <= 40:
            self.out.append(("heading", 2, text))
        elif text:
            self.out.append((self.kind, self.level, text))

    def row(self) -> None:
        """Ends the open table row: the first of a table names the columns."""
        cells, self.cells = self.cells, None
        if cells and not self.header:
            self.header = cells
        elif cells:
            named = [f"{self.header[i] if i < len(self.header) else f'列{i + 1}'}：{c}" for i, c in enumerate(cells)]
            self.out.append(("table_row", 0, "；".join(named)))

    def end_paragraph(self) -> None:
        """A block that begins ends the paragraph it stands in, up to the nearest container."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == "p":
                del self.open[i:]
            if i >= len(self.open) or self.open[i][0] in _BREAK or self.open[i][0] in ("td", "th"):
                break

    def handle_starttag(self, tag, attrs):
        d = {k: v or "" for k, v in attrs}
        if tag in _BREAK or tag in ("td", "th"):
            self.flush()
            self.end_paragraph()
        if tag not in _VOID:
            self.open.append((tag, tag in _SKIP or self.rules.skips(d), self.by is not None and self.rules.is_content(d, self.by)))
        if tag in ("strong", "b"):
            self.bold += 1
        if tag in _HEAD:
            self.kind, self.level = "heading", _HEAD[tag]
        elif tag == "li":
            self.kind, self.level = "list", 0
        elif tag in ("p", "div"):
            self.kind, self.level = "paragraph", 0
        elif tag == "tr":
            self.row()
            self.cells = []
        elif tag == "table":
            self.header = []

    def handle_endtag(self, tag):
        if tag in _BREAK or tag in ("td", "th"):
            self.flush()
        if tag in ("tr", "table"):
            self.row()
        if tag in _HEAD or tag == "li":
            self.kind, self.level = "paragraph", 0
        if tag in ("strong", "b"):
            self.bold = max(0, self.bold - 1)
        # an end tag closes what is open inside it; one without a start is ignored
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if any(t == "title" for t, *_ in self.open):
            self.title += data
        elif self.counted:
            self.buffer.append(data)
            self.plain |= bool(data.strip()) and not self.bold


def parse_html(html: str, rules: PageRules | None = None) -> tuple[str, list[tuple[str, int, str]]]:
    """(title, elements as (kind, level, text)) of a page."""
    by = None
    if rules and (rules.content_ids or rules.content_classes):
        scout = _Scout(rules)
        scout.feed(html)
        by = "id" if "id" in scout.seen else "class" if "class" in scout.seen else None
    p = _Page(rules, by)
    p.feed(html)
    p.close()
    p.flush()
    return p.title.strip(), p.out


def html_elements(pages: DataFrame, key: str, html: str = "html", rules: PageRules | None = None) -> DataFrame:
    """(key, seq, kind, level, text) of the elements of each page."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            rows = [(k, i, *e) for k, h in zip(b[key], b[html], strict=True) if h is not None for i, e in enumerate(parse_html(h, rules)[1])]
            yield pd.DataFrame(rows, columns=[key, "seq", "kind", "level", "text"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, seq bigint, kind string, level int, text string")


def html_text(pages: DataFrame, key: str, html: str = "html", rules: PageRules | None = None) -> DataFrame:
    """(key, text): the elements of each page as lines."""
    e = html_elements(pages, key, html, rules).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("x"))
    return e.select(key, F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))


def mediawiki_html(answers: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, title, html) of answers of a MediaWiki server; the text may be a string or an object with a "*" entry."""
    star = F.try_element_at(F.from_json(body, "parse struct<text:map<string,string>>")["parse"]["text"], F.lit("*"))
    return answers.select(key, F.get_json_object(body, "$.parse.title").alias("title"), F.coalesce(star, F.get_json_object(body, "$.parse.text")).alias("html"))


def write_corpus(elements: DataFrame, key: str, path: str) -> None:
    """A parsed corpus as JSON lines of documents with their elements, and a report of elements by kind beside it."""
    docs = elements.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "level", "text"))).alias("elements"))
    docs.write.mode("overwrite").json(f"{path}/documents")
    elements.groupBy("kind").agg(F.countDistinct(key).alias("documents"), F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars")).write.mode("overwrite").json(f"{path}/report")


def write_traces(events: DataFrame, case: str, order: str, path: str) -> None:
    """Traces as JSON lines, a case a line with its events in order, and a summary of cases and events by last state beside them."""
    cols = [c for c in events.columns if c not in (case, order)]
    per = events.groupBy(case).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("events"), F.count("*").alias("n"), F.max_by("to_status", order).alias("last"))
    per.select(case, "events").write.mode("overwrite").json(f"{path}/traces")
    per.groupBy("last").agg(F.count("*").alias("cases"), F.sum("n").alias("events")).write.mode("overwrite").json(f"{path}/summary")


def manifest_file(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A manifest of one JSON document (an array of objects), with or without a byte order mark."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
    return text.select(F.explode(F.from_json("v", f"array<{schema if isinstance(schema, str) else schema.simpleString()}>")).alias("r")).select("r.*")


def checked_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a JSON lines file read strictly: blank lines are skipped; a line that is no JSON object fails with its number. Numbers run within the file, which is read by one task."""
    import json

    def run(batches):
        for b in batches:
            rows = []
            for text in b["value"]:
                for n, line in enumerate(text.split("\n"), 1):
                    if not line.strip():
                        continue
                    try:
                        ok = isinstance(json.loads(line), dict)
                    except ValueError:
                        ok = False
                    if not ok:
                        raise ValueError(f"line {n} is no JSON object")
                    rows.append((n, line))
            yield pd.DataFrame(rows, columns=["line_no", "value"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "line_no bigint, value string")


def table_summary(df: DataFrame) -> DataFrame:
    """(text): rows and column names of a table as one sentence."""
    names = "、".join(df.columns)
    return df.agg(F.concat(F.lit("表格共 "), F.count("*").cast("string"), F.lit(f" 行，列：{names}")).alias("text"))


def has_header(first: list[str]) -> bool:
    """Whether the first row of a table names its columns: at most half of its cells are numbers."""
    numbers = sum(bool(re.fullmatch(r"[-+]?\d+(?:[.,]\d+)?%?", (c or "").strip())) for c in first)
    return numbers <= len(first) / 2


def request_keys(requests: DataFrame, body: str, trial: str) -> DataFrame:
    """Requests with their key: the SHA-256 of the body with "#" and the trial."""
    return requests.withColumn("key", F.sha2(F.concat_ws("#", F.col(body), F.col(trial).cast("string")), 256))


def replayed(requests: DataFrame, own: DataFrame, base: DataFrame) -> DataFrame:
    """Requests (key) with their recorded answer: the own record first, else the base one; one without a record fails the query."""
    j = requests.join(own.select("key", F.col("body").alias("_own")), "key", "left").join(base.select("key", F.col("body").alias("_base")), "key", "left")
    return j.withColumn("body", F.coalesce("_own", "_base", F.raise_error(F.concat(F.lit("no record of "), F.col("key"))).cast("string"))).drop("_own", "_base")


def unfetched(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Rows (doc_id, sha256) whose content isn't held yet."""
    return wanted.join(have, ["doc_id", "sha256"], "left_anti")


def hash_store(df: DataFrame, corpus_hash: str, revision: str) -> str:
    """Writes vectors as a Parquet table named by corpus hash and revision in the shared folder; an existing one is used again."""
    path = f"{shared_dir(df.sparkSession)}/{corpus_hash[:16]}_{revision[:12]}"
    df.write.mode("ignore").parquet(path)
    return path
