"""Model replies: JSON recovery and schema checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, strip
from ..functions.defaults import CONCEPT_TYPES, CONFIDENCE


def _object(text: Column) -> Column:
    """``text`` when it is one complete JSON object.

    The parser accepts text after a value, so the candidate is parsed inside a
    larger object whose last key must survive.
    """

    def verdict(boxed: Column) -> Column:
        whole = F.try_variant_get(boxed, "$.end", "int") == 1
        kind = F.schema_of_variant(F.try_variant_get(boxed, "$.v", "variant"))
        return F.struct(F.coalesce(whole, F.lit(False)).alias("parses"), F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("is_object"))

    return let(F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":1}'))), verdict)


def extract_json(text: Column) -> Column:
    """G1: the JSON object of a reply: a fenced block, the whole text, or first brace to last.

    Text that parses as something other than an object is refused.
    """

    def recover(candidate: Column) -> Column:
        first, last = F.locate("{", candidate), F.length(candidate) - F.locate("}", F.reverse(candidate)) + 1
        inner = F.when((first > 0) & (candidate.contains("}")) & (last > first), F.substring(candidate, first, last - first + 1))
        return let(
            _object(candidate),
            lambda whole: F.when(whole["parses"], F.when(whole["is_object"], candidate)).otherwise(
                let(inner, lambda part: F.when(let(_object(part), lambda o: o["parses"] & o["is_object"]), part))
            ),
        )

    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return let(
        strip(text),
        lambda t: let(F.when(t.rlike(fence), strip(F.regexp_extract(t, fence, 1))).otherwise(t), recover),
    )


@dataclass(frozen=True)
class Text:
    most: int | None = None
    default: str | None = ""
    required: bool = False
    nullable: bool = False
    sql = "string"

    def ok(self, v: Column, kind: Column) -> Column:
        value = strip(F.try_variant_get(v, "$", "string"))
        good = kind == "STRING"
        if self.most:
            good = good & (F.length(value) <= self.most)
        return _absent_ok(self, kind, good)

    def read(self, v: Column, kind: Column) -> Column:
        return F.coalesce(F.when(kind == "STRING", strip(F.try_variant_get(v, "$", "string"))), F.lit(self.default))


@dataclass(frozen=True)
class Choice:
    values: tuple[str, ...]
    default: str
    required: bool = False
    nullable: bool = False
    sql = "string"

    def ok(self, v: Column, kind: Column) -> Column:
        return _absent_ok(self, kind, (kind == "STRING") & F.try_variant_get(v, "$", "string").isin(*self.values))

    def read(self, v: Column, kind: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(self.default))


@dataclass(frozen=True)
class Number:
    low: float
    high: float
    default: float | None = None
    whole: bool = False
    required: bool = False
    nullable: bool = False

    @property
    def sql(self) -> str:
        return "int" if self.whole else "double"

    def ok(self, v: Column, kind: Column) -> Column:
        value = F.try_variant_get(v, "$", "double")
        good = (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") | (kind == "STRING")) & value.between(self.low, self.high)
        if self.whole:
            good = good & (value == F.floor(value))
        return _absent_ok(self, kind, F.coalesce(good, F.lit(False)))

    def read(self, v: Column, kind: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(self.default)).cast(self.sql)


@dataclass(frozen=True)
class Flag:
    default: bool
    required: bool = False
    nullable: bool = False
    sql = "boolean"

    def ok(self, v: Column, kind: Column) -> Column:
        return _absent_ok(self, kind, (kind == "BOOLEAN") | F.try_variant_get(v, "$", "boolean").isNotNull())

    def read(self, v: Column, kind: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(self.default))


@dataclass(frozen=True)
class Texts:
    most: int
    required: bool = False
    nullable: bool = False
    sql = "array<string>"

    def ok(self, v: Column, kind: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        good = kind.startswith("ARRAY") & (F.size(items) <= self.most) & F.forall(items, lambda i: F.schema_of_variant(i) == "STRING")
        return _absent_ok(self, kind, good)

    def read(self, v: Column, kind: Column) -> Column:
        return F.coalesce(
            F.transform(F.try_variant_get(v, "$", "array<string>"), strip), F.array().cast("array<string>")
        )


@dataclass(frozen=True)
class Items:
    most: int
    fields: dict
    required: bool = False
    nullable: bool = False

    @property
    def sql(self) -> str:
        return f"array<struct<{','.join(f'{n}:{f.sql}' for n, f in self.fields.items())}>>"

    def ok(self, v: Column, kind: Column) -> Column:
        items = F.try_variant_get(v, "$", "array<variant>")
        each = lambda i: F.schema_of_variant(i).startswith("OBJECT") & _fields_ok(i, self.fields)
        good = let(items, lambda held: (F.size(held) <= self.most) & F.forall(held, each))
        return _absent_ok(self, kind, kind.startswith("ARRAY") & good)

    def read(self, v: Column, kind: Column) -> Column:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda i: _read(i, self.fields))
        return F.coalesce(items, F.array().cast(self.sql))


def _absent_ok(field, kind: Column, good: Column) -> Column:
    """A missing key is fine unless required; an explicit null only where allowed."""
    out = F.when(kind.isNull(), F.lit(not field.required)).when(kind == "VOID", F.lit(field.nullable))
    return out.otherwise(F.coalesce(good, F.lit(False)))


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _ok(v: Column, name: str, field) -> Column:
    """Whether a field holds: it is taken out, and its kind looked at, once."""
    return let(_part(v, name), lambda part: let(F.schema_of_variant(part), lambda kind: field.ok(part, kind)))


def _fields_ok(v: Column, fields: dict) -> Column:
    out = F.lit(True)
    for name, field in fields.items():
        out = out & _ok(v, name, field)
    return out


def _read(v: Column, fields: dict) -> Column:
    read = lambda field: lambda part: field.read(part, F.schema_of_variant(part))
    return F.struct(*[let(_part(v, name), read(field)).alias(name) for name, field in fields.items()])


def _id(**kw) -> Text:
    return Text(default=None, nullable=True, **kw)


_CLAIM = {"statement": Text(2000, required=True), "chunk_id": _id(), "paper_id": _id(), "section": _id()}
_EVIDENCE = {"chunk_id": _id(), "paper_id": _id(), "paper_title": _id(most=1000), "section": _id(), "quote": Text(1200)}

# Fields, limits and defaults of each task's reply.
SCHEMAS: dict[str, dict] = {
    "summary": {
        "research_problem": Text(4000), "approach": Text(4000), "key_findings": Texts(12), "limitations": Texts(12),
        "takeaway": Text(600),
    },
    "keyword_extraction": {
        "concepts": Items(40, {
            "concept": Text(255, required=True), "concept_type": Choice(CONCEPT_TYPES, "keyword"),
            "confidence": Number(0.0, 1.0, 0.5),
        }),
    },
    "metadata_cleanup": {
        "title": _id(most=1000), "authors": Texts(30), "year": Number(1900, 2100, whole=True, nullable=True),
        "venue": _id(most=500),
    },
    "qa": {
        "answer": Text(8000), "claims": Items(20, _CLAIM), "evidence_sufficient": Flag(True),
        "confidence": Choice(CONFIDENCE, "medium"), "limitations": Text(2000),
    },
    "comparison": {
        "papers": Items(3, {"paper_id": Text(required=True), "title": Text(1000, required=True)}),
        "dimensions": Items(15, {"name": Text(120, required=True), "values": Texts(3)}),
        "confidence": Choice(CONFIDENCE, "medium"), "limitations": Text(2000),
    },
    "research_gap": {
        "gaps": Items(10, {
            "statement": Text(1500, required=True), "supporting_papers": Texts(30), "evidence": Items(10, _EVIDENCE),
            "why_underexplored": Text(2000), "confidence": Choice(CONFIDENCE, "low"),
        }),
        "corpus_size": Number(-(2**31), 2**31 - 1, 0, whole=True), "limitations": Text(2000),
    },
    "novelty": {
        "similar_work": Items(15, {
            "title": Text(1000, required=True), "paper_id": _id(), "external_id": _id(),
            "similarity": Number(0.0, 1.0, nullable=True), "why_similar": Text(1500),
        }),
        "overlap": Texts(12), "existing_methodologies": Texts(12), "differences": Texts(12),
        "potentially_novel": Texts(12), "evidence": Items(20, _EVIDENCE), "confidence": Choice(CONFIDENCE, "low"),
        "limitations": Text(2000),
    },
    "classification": {
        "enabled": Flag(False), "agreements": Texts(12), "disagreements": Texts(12),
        "second_opinion_available": Flag(False),
    },
    "literature_review": {
        "overview": Text(6000),
        "themes": Items(10, {"name": Text(200, required=True), "description": Text(3000), "supporting_papers": Texts(30)}),
        "methodologies": Texts(15), "datasets": Texts(15), "agreements": Texts(12), "contradictions": Texts(12),
        "limitations": Texts(12),
        "references": Items(60, {
            "paper_id": _id(), "title": Text(1000, required=True), "year": Number(-(2**31), 2**31 - 1, whole=True, nullable=True),
        }),
        "confidence": Choice(CONFIDENCE, "medium"),
    },
}


def parse_replies(replies: DataFrame, task: str, text_col: str = "text") -> DataFrame:
    """Replies of one task with ``valid``, ``reject_reason`` and the typed ``result``.

    Unknown keys are dropped, defaults filled, text trimmed; any breach of a type,
    value or limit rejects the whole reply.
    """
    fields = SCHEMAS[task]

    def check(v: Column) -> Column:
        broken = F.array_compact(F.array(*[F.when(~_ok(v, name, field), F.lit(name)) for name, field in fields.items()]))
        return let(
            F.when(v.isNull(), "NO_JSON_OBJECT").otherwise(
                let(broken, lambda b: F.when(F.size(b) > 0, F.concat(F.lit("INVALID:"), F.array_join(b, ","))))
            ),
            lambda reason: F.struct(reason.alias("reject_reason"), F.when(reason.isNull(), _read(v, fields)).alias("result")),
        )

    # A generator's value is not worked out again by a filter on ``valid``.
    checked = replies.select("*", F.explode(F.array(let(F.try_parse_json(extract_json(F.col(text_col))), check))).alias("_checked"))
    return checked.select(
        *replies.columns,
        F.col("_checked.reject_reason").isNull().alias("valid"),
        F.col("_checked.reject_reason"),
        F.col("_checked.result"),
    )


def concept_rows(parsed: DataFrame, key: str = "paper_id") -> DataFrame:
    """Accepted concepts, at most 255 characters, once per paper, name and type."""
    rows = parsed.filter("valid").select(key, F.posexplode("result.concepts").alias("pos", "c"))
    named = rows.select(
        key, "pos", F.left("c.concept", F.lit(255)).alias("concept"), "c.concept_type", F.col("c.confidence").cast("float").alias("confidence")
    )
    return named.groupBy(key, "concept", "concept_type").agg(F.min_by("confidence", "pos").alias("confidence"))
