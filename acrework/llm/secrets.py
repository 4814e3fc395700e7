"""Secret scans of whole texts through a trigram inverted index.

Each task indexes its texts segment by segment: only trigrams that some rule's query mentions get postings.  A rule's
candidates come from intersecting and uniting postings; candidates alone are matched with the expression.  A rule
without mandatory trigrams (runs of hexadecimal digits) is matched against every text.  Nothing is shuffled.

Defined results: null text is an empty text without spans; repeated rows give repeated results; other columns are
ignored; offsets are code points, ends exclusive; matches are leftmost and do not overlap within a kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from acrework.llm.common import documents, text_slices, utf8
from acrework.llm.trigram_query import TrigramIndex, WantedTrigrams, trigram_query


@dataclass(frozen=True)
class Rule:
    """An expression; matches whose ``group`` is shorter than ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = 0


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.IGNORECASE | re.ASCII),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
RULES = (
    *BASE_RULES,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    # what follows the first part is optional only so that a run without it is passed over once; such matches are dropped
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}(\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})?", 1, 1),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[^\s/@:]{3,}@"),
)
_WORKER: dict[tuple[Rule, ...], "Scanner"] = {}


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(self._faster(r), r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.wanted = WantedTrigrams(self.queries)

    @staticmethod
    def _faster(rule: Rule) -> str:
        """A run of one class that must be long is matched as such: a maximal run matches either way."""
        m = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
        return f"{m[1]}{{{rule.least},}}" if m and rule.group == 0 and rule.least else rule.pattern

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), in that order."""
        data, offsets = utf8(column)
        texts = column.to_pylist()
        index = TrigramIndex(data, offsets, self.wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, compiled, query) in enumerate(zip(self.rules, self.compiled, self.queries)):
            for i in index.candidates(query).tolist():
                for m in compiled.finditer(texts[i] or ""):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    if rules not in _WORKER:
        _WORKER[rules] = Scanner(rules)
    scanner, kind = _WORKER[rules], pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    for batch in text_slices(batches, "text"):
        spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in each] for each in scanner.scan(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names] + [pa.array(spans, pa.list_(kind))], [*batch.schema.names, "secret_spans"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``secret_spans``: array of (kind, start, end), by start, then by the rules' order."""
    source = docs.select(*dict.fromkeys((*keep, "text"))).withColumn("text", F.col("text").cast("string"))
    rows = source.mapInArrow(lambda it: _scan(it, rules), _with_spans(source))
    return rows.select(*keep, "secret_spans")


def _with_spans(source: DataFrame) -> StructType:
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return StructType([*source.schema.fields, StructField("secret_spans", ArrayType(span))])


def _redact(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], mark: str) -> Iterator[pa.RecordBatch]:
    if rules not in _WORKER:
        _WORKER[rules] = Scanner(rules)
    for batch in text_slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(_WORKER[rules].scan(batch.column("text"))):
            if not spans:
                continue
            parts, at = [], 0
            for start, _, end in spans:  # by start; overlapping spans share one mark
                if start >= at:
                    parts += [texts[i][at:start], mark]
                at = max(at, end)
            texts[i] = "".join([*parts, texts[i][at:]])
        yield batch.set_column(batch.schema.names.index("text"), "text", pa.array(texts, pa.string()))


def redact_secrets(docs: DataFrame, mark: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows with every secret in ``text`` replaced by a mark; null text stays null."""
    source = docs.withColumn("text", F.col("text").cast("string"))
    return source.mapInArrow(lambda it: _redact(it, rules, mark), source.schema)


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    spans = F.col("secret_spans")
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(documents(spark, sf_dir)).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )
