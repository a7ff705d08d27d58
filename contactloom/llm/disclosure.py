"""Personal data: base patterns, and terms that reveal what they stand beside."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm.tables import small, table, text_key
from contactloom.session import stored

KINDS = ("email", "ip", "card", "phone")
# Words on either side of a protected entity that count as beside it, and their least length.
REACH, LEAST_LETTERS = 8, 3
# Counts must speak against chance by so much (log-likelihood ratio, one in a thousand by chance) ...
LEAST_SUPPORT = 10.83
# ... and give away this share of the entity's information; above the second share it is removed.
LEAST_DISCLOSURE, REMOVE_FROM = 0.8, 0.95

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_NO_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Address matches, from each ``@`` to its left and right, so that no run is tried from every start."""
    out, at, after = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        # What lies between two matches is looked at once.
        after = domain.end() if domain else at + 1
        if domain:
            out.append((start, domain.end()))
        at = text.find("@", max(after, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` in code points, by kind as listed and start; matches of one kind do not overlap."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def _entity(kind: str, value: str) -> str:
    plain = value.lower() if kind == "email" else value if kind == "ip" else _NO_DIGITS.sub("", value)
    return f"{kind}:{plain}"


def _beside(text: str, spans: list[tuple[str, int, int]]) -> dict[str, set[str]]:
    """Per protected entity the terms beside it; words inside any span are no terms."""
    marks = sorted((a, b) for _, a, b in spans)

    def free(start: int, end: int) -> bool:
        return all(end <= a or start >= b for a, b in near)

    out: dict[str, set[str]] = {}
    for kind, a, b in spans:
        low, high = max(0, a - 40 * REACH), min(len(text), b + 40 * REACH)
        near = [m for m in marks if m[1] > low and m[0] < high]
        before = [m for m in _WORD.finditer(text, low, a) if m.start() > low or low == 0]
        behind = [m for m in _WORD.finditer(text, b, high) if m.end() < high or high == len(text)]
        words = [m for m in before if free(m.start(), m.end())][-REACH:]
        words += [m for m in behind if free(m.start(), m.end())][:REACH]
        own = out.setdefault(_entity(kind, text[a:b]), set())
        own.update(w for m in words if len(w := m[0].lower()) >= LEAST_LETTERS)
    return out


_FOUND = "base string, n_email long, n_ip long, n_card long, n_phone long, beside array<struct<entity:string,terms:array<string>>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    beside_type = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))
    for batch in batches:
        spans = [base_spans(t or "") for t in batch.column("text").to_pylist()]
        beside = []
        for text, own in zip(batch.column("text").to_pylist(), spans, strict=True):
            found = _beside(text, own) if own else {}
            beside.append([{"entity": entity, "terms": sorted(terms)} for entity, terms in found.items()])
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in ("doc_id", "text_a", "text_b")],
                pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in own) for own in spans], pa.string()),
                *[pa.array([sum(k == kind for k, _, _ in own) for own in spans], pa.int64()) for kind in KINDS],
                pa.array(beside, beside_type),
            ],
            names=["doc_id", "text_a", "text_b", *[c.split()[0] for c in _FOUND.split(", ")]],
        )


def _terms_of(text: Column) -> Column:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= LEAST_LETTERS))


def _support(both: Column, term: Column, entity: Column, n: int) -> Column:
    """Log-likelihood ratio of documents with both against chance, from those with either and all ``n``."""

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    cells = (both, term - both, entity - both, n - term - entity + both)
    sides = (term, n - term, entity, n - entity)
    return 2 * (sum(map(part, cells), part(F.lit(n))) - sum(map(part, sides), F.lit(0.0)))


def revealing_terms(
    docs: DataFrame,
    found: DataFrame,
    least_support: float = LEAST_SUPPORT,
    least_disclosure: float = LEAST_DISCLOSURE,
) -> DataFrame:
    """``text_a, text_b, terms``: the revealing terms each text holds, with the share they disclose.

    A term beside an entity discloses the share ``PMI(term, entity) / -log p(entity)`` of it, from counts over all
    documents; 1 if the term never stands anywhere else. One document can be enough: what counts is that the numbers of
    documents, all together, are not chance (``_support``). Pairs are counted from those found beside entities;
    the documents of terms by partial counts in each task.
    """
    pairs = (
        found.select(F.explode("beside").alias("b"))
        .select("b.entity", F.explode("b.terms").alias("term"))
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("n_pair"))
    )
    of_entity = (
        found.select(F.explode("beside").alias("b"))
        .groupBy("b.entity")
        .agg(F.count(F.lit(1)).alias("n_entity"))
    )
    n = found.count()

    def share(n_term: Column) -> Column:
        """What a term of so many documents discloses."""
        found_by = F.col("n_pair") * n / (n_term * F.col("n_entity"))
        return F.least(F.log(found_by) / F.log(n / F.col("n_entity")), F.lit(1.0))

    # A term has at least the documents in which it stands beside an entity, any entity. That bounds
    # what it can disclose and leaves few pairs.
    of_beside = (
        found.filter(F.size("beside") > 0)
        .select(F.explode(F.array_distinct(F.flatten("beside.terms"))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_beside"))
    )
    pairs = stored(
        pairs.join(of_entity, "entity")
        .filter(F.col("n_entity") < n)
        .join(of_beside, "term")
        .filter(share(F.col("n_beside")) >= least_disclosure)
    )
    held = docs.select(
        *text_key(F.col("text")), F.explode(_terms_of(F.col("text"))).alias("term")
    )
    of_term = held.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    revealing = (
        pairs.join(of_term, "term")
        .withColumn("share", share(F.col("n_term")))
        .filter(F.col("share") >= least_disclosure)
        .filter(_support(F.col("n_pair"), F.greatest("n_term", "n_pair"), F.col("n_entity"), n) >= least_support)
        .groupBy("term")
        .agg(F.max("share").alias("share"))
    )
    revealing = small(stored(revealing))
    return (
        held.join(revealing, "term")
        .distinct()
        .groupBy("text_a", "text_b")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))
    )


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the revealing terms stand in texts, outside base spans."""
    for batch in batches:
        out = []
        for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True):
            known = dict(terms)
            base = sorted((a, b) for _, a, b in base_spans(text))
            found, k, reach = [], 0, 0
            for m in _WORD.finditer(text):
                while k < len(base) and base[k][0] < m.end():
                    reach = max(reach, base[k][1])
                    k += 1
                if m.start() >= reach and m[0].lower() in known:
                    found.append(f"term:{m.start()}:{m.end()}")
            out.append(found)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("text_a"),
                batch.column("text_b"),
                pa.array([",".join(x) for x in out], pa.string()),
                pa.array([len(x) for x in out], pa.int64()),
            ],
            names=["_a", "_b", "term_spans", "n_term"],
        )


def personal_spans(
    docs: DataFrame,
    least_support: float = LEAST_SUPPORT,
    least_disclosure: float = LEAST_DISCLOSURE,
) -> DataFrame:
    """Personal data of whole texts.

    ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``. Base spans come from the patterns; to
    them come the words (kind ``term``) that disclose an entity (``revealing_terms``), wherever they stand
    outside base spans. Spans are ``kind:start:end`` in code points, by kind, then start.

    NULL texts count as empty and have no spans. Every row gives a row, whatever its id; equal texts get equal spans. Other columns
    are left out. An entity or term that a third of the documents hold is only ever counted.
    """
    given = docs.select("doc_id", *text_key(F.col("text")), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(given.mapInArrow(_find, f"doc_id {kind}, text_a long, text_b int, {_FOUND}"))
    revealed = small(stored(revealing_terms(docs, found, least_support, least_disclosure)))
    texts = docs.select(*text_key(F.col("text")), "text").join(revealed, ["text_a", "text_b"])
    located = texts.mapInArrow(_locate, "_a long, _b int, term_spans string, n_term long")
    located = located.dropDuplicates(["_a", "_b"])
    return (
        found.join(located, (F.col("text_a") == F.col("_a")) & (F.col("text_b") == F.col("_b")), "left")
        .select(
            "doc_id",
            *[f"n_{kind}" for kind in KINDS],
            F.sha2("base", 256).alias("base_sha256"),
            F.concat_ws(",", *[F.when(F.col(c) != "", F.col(c)) for c in ("base", "term_spans")]).alias("spans"),
            F.coalesce("n_term", F.lit(0)).cast("long").alias("n_term"),
        )
    )


def _shape(word: str) -> str:
    return "<number>" if word.isdigit() else "<name>" if word[:1].isupper() else "<word>"


def sanitised(text: str, terms: dict[str, float], remove_from: float = REMOVE_FROM) -> str:
    """``text`` with base spans named by kind; terms are removed, or made general if they disclose less."""
    marks = [(a, b, f"<{kind}>") for kind, a, b in base_spans(text)]
    covered = sorted((a, b) for a, b, _ in marks)
    for m in _WORD.finditer(text):
        share = terms.get(m[0].lower())
        if share is not None and all(m.end() <= a or m.start() >= b for a, b in covered):
            marks.append((m.start(), m.end(), "" if share >= remove_from else _shape(m[0])))
    out, at = [], 0
    for a, b, put in sorted(marks):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join(out) + text[at:]


def _sanitise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean = [
            None if t is None else sanitised(t, dict(terms or ()))
            for t, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(clean, pa.string())], names=["doc_id", "text"]
        )


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with personal data named by kind and revealing terms made general or removed."""
    given = docs.select("doc_id", *text_key(F.col("text")), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(given.mapInArrow(_find, f"doc_id {kind}, text_a long, text_b int, {_FOUND}"))
    revealed = small(stored(revealing_terms(docs, found)))
    return (
        given.join(revealed, ["text_a", "text_b"], "left")
        .select("doc_id", "text", "terms")
        .mapInArrow(_sanitise, f"doc_id {kind}, text string")
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_spans(table(spark, sf_dir, "documents"))
