"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score.

Everything is a projection of built-in functions over the row's own text: no shuffle, no Python.
The patterns are written with possessive quantifiers and run-start lookbehinds, which leave the
matches as they are but keep the matcher linear on long runs of one character class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgraph.llm.common import cut_out, find_spans, fresh, joined_spans, let, literal, pieces_of, quoted, running, text_or_empty

#: Code points on either side of a span that are searched for context words.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """``base``: score of a confirmed span; ``boost``: what a context word nearby adds."""

    name: str
    pattern: str
    needs: str
    words: str
    base: float
    boost: float


#: ASCII word boundaries; Java's own take in letters of all scripts.
_L, _R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: In the order in which spans with one start are listed.  The first four are the base kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"e-?mail|contact|write|mailto", 0.9, 0.1),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", rf"{_L}ip{_R}|address|host|server|login", 0.7, 0.2),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", r"[0-9][\x20-]?[0-9]", r"card|visa|master|amex|credit|debit|payment", 0.8, 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", rf"phone|tel{_R}|call|mobile|fax|whatsapp", 0.8, 0.2),
    Kind("iban", rf"{_L}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?{_R}", r"[A-Z]{2}[0-9]{2}", r"iban|account|bank|konto|compte|cuenta", 0.8, 0.2),
    Kind("ssn", rf"{_L}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_R}", r"[0-9]-[0-9]{2}-[0-9]", rf"{_L}ssn{_R}|social\s+security", 0.2, 0.6),
    Kind("local_phone", rf"{_L}[0-9]{{3}}[\x20.-][0-9]{{3}}[.-][0-9]{{4}}{_R}", r"[0-9][.-][0-9]{4}", rf"phone|tel{_R}|call|mobile|fax|whatsapp", 0.3, 0.5),
)
BASE = ("email", "ip", "card", "phone")
SCORED = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"
#: A span of a further kind counts from this score on; base spans always do.
THRESHOLD = 0.5


def luhn(digits: str) -> str:
    """Whether a string of digits ends in its Luhn check digit."""
    digit = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    weighed = f"if(i % 2 = 0, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (acc, i) -> acc + {weighed}) % 10 = 0"


def mod97(iban: str) -> str:
    """Whether a bank account number without spaces has the remainder 1 under the mod-97 rule."""
    step = "if(c between '0' and '9', (acc * 10 + cast(c as int)) % 97, (acc * 100 + ascii(c) - 55) % 97)"
    turned = f"concat(substring({iban}, 5), substring({iban}, 1, 4))"
    return f"aggregate(regexp_extract_all({turned}, '.', 0), 0, (acc, c) -> {step}) = 1"


def _confirmed(kind: str, value: str) -> str:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return f"rlike({value}, {literal(rf'^{part}(?:[.]{part}){{3}}$')})"
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "card":
        return let(digits, "d", f"if(length(d) <= 19, {luhn('d')}, false)")
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    if kind == "iban":
        return let(f"replace({value}, ' ', '')", "d", f"if(length(d) between 15 and 34, {mod97('d')}, false)")
    return "true"


def pii_spans(text: str) -> str:
    """array<struct<start,rank,kind,end,score>> of a non-null text, unsorted."""
    found = []
    for rank, k in enumerate(KINDS):
        guard = f"contains({text}, '@')" if k.needs == "@" else f"rlike({text}, {literal(k.needs)})"
        near = f"concat_ws(' ', {cut_out('ps', f'greatest(s.start - {CONTEXT}, 0)', 's.start')}, {cut_out('ps', 's.end', f'least(s.end + {CONTEXT}, n)')})"
        score = f"{k.base}D + if(rlike({near}, {literal(f'(?i){k.words}')}), {k.boost}D, 0D)"
        one = f"named_struct('start', s.start, 'rank', {rank}, 'kind', '{k.name}', 'end', s.end, 'score', {score})"
        scored = f"if(size(cs) > 0, {let(pieces_of(text), 'ps', let(f'length({text})', 'n', f'transform(cs, s -> {one})'))}, null)"
        confirmed = f"filter({find_spans(text, k.pattern, guard)}, s -> {_confirmed(k.name, 's.value')})"
        spans = let(confirmed, "cs", scored)
        if k.name not in BASE:
            spans = f"filter({spans}, s -> s.score >= {THRESHOLD}D)"
        found.append(f"coalesce({spans}, cast(array() as {SCORED}))")
    return f"concat({', '.join(found)})"


def detect_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Append ``out``: the row's spans, sorted by start and kind.

    A null or empty text has an empty array.  Rows are independent: repeated rows, null keys and
    further columns are carried as they are (a column named like ``out`` is replaced).
    """
    return df.withColumn(out, F.expr(let(text_or_empty(text), "t", f"array_sort({pii_spans('t')})")))


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span in the text by [KIND]; overlapping spans become one, named by the first.

    A null text stays null.  All other columns are kept.
    """
    spans = fresh(df, "_pii")
    found, t = quoted(spans), quoted(text)
    # the furthest end of the spans before each: one that begins there or later ends a gap
    both = f"zip_with({found}, slice(es, 1, size({found})), (s, e) -> named_struct('start', s.start, 'kind', s.kind, 'before', e))"
    parts = f"transform(filter({both}, s -> s.start >= s.before), s -> concat({cut_out('ps', 's.before', 's.start')}, '[', upper(s.kind), ']'))"
    tail = cut_out("ps", "element_at(es, -1)", f"length({t})")
    joined = let(pieces_of(t), "ps", f"concat(array_join({parts}, ''), {tail})")
    masked = let(f"transform({found}, s -> s.end)", "ns", let(running("ns", "greatest({}, {})"), "es", joined))
    return detect_pii(df, text, spans).withColumn(text, F.expr(f"if(size({found}) > 0, {masked}, {t})")).select(*df.columns)


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans, and all spans."""
    found = detect_pii(docs.select("doc_id", "text"))
    base = f"filter(pii, s -> s.kind in ({', '.join(map(literal, BASE))}))"
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(pii, s -> s.kind = '{k}')) as long) as n_{k}" for k in BASE],
        f"sha2(cast({joined_spans(base)} as binary), 256) as base_sha256",
        f"{joined_spans('pii')} as spans",
        "array_max(transform(pii, s -> s.score)) as top_score",
    )
