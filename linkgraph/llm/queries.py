"""The registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgraph.llm.ann import nearest, valid_vectors
from linkgraph.llm.bpe import token_digest
from linkgraph.llm.decontaminate import contamination_report
from linkgraph.llm.filters import filter_audit
from linkgraph.llm.jaccard import jaccard_report
from linkgraph.llm.pii import pii_digest
from linkgraph.llm.ranked import ranked_report
from linkgraph.llm.secrets import secrets_digest
from linkgraph.llm.sharding import assign_shards
from linkgraph.llm.simhash import simhash_digest
from linkgraph.llm.suffixes import passage_report
from linkgraph.llm.tokenfile import tokenfile_digest
from linkgraph.llm.toxicity import toxicity_digest

#: Where the vocabulary files of the public tokenizers are.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = _read(spark, sf_dir, "benchmark", "item_id", "text")
    return contamination_report(_read(spark, sf_dir, "documents", "doc_id", "text"), benchmark)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return token_digest(docs, BYTE_BPE, public_tokenizers.PATTERN)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return nearest(vectors, vectors.where(F.col("key") % 50 == 0))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile_digest(_read(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    eight = {i: 1.0 for i in range(8)}
    out = assign_shards(docs, "doc_id", "text", eight, grown=eight | {8: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity_digest(_read(spark, sf_dir, "documents", "doc_id", "text"), labels)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return filter_audit(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"), labels)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark", "item_id", "text")
    return ranked_report(_read(spark, sf_dir, "documents", "doc_id", "text"), items)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(_read(spark, sf_dir, "documents", "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_decontamination": op2_decontamination,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_ann": op4_ann,
        "op5_token_files": op5_token_files,
        "op6_sharding": op6_sharding,
        "op7_toxicity": op7_toxicity,
        "op8_pii": op8_pii,
        "op9_secrets": op9_secrets,
        "op10_passages": op10_passages,
        "op11_filter_audit": op11_filter_audit,
        "op12_ranked_search": op12_ranked_search,
        "op13_jaccard_join": op13_jaccard_join,
        "pipeline": pipeline,
    }


#: The rules of the secret scan in RE2's dialect: pattern, and what a match must hold.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_RULES = {
    "assign": (_ASSIGN + "[A-Za-z0-9+/_.=-]+", f"^{_ASSIGN}[A-Za-z0-9+/_.=-]{{8,}}"),
    "access": ("AKIA[A-Z0-9]+", "^.{16,}$"),
    "hex": ("[0-9a-f]+", "^.{32,}$"),
    "pem": ("-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ""),
    "github": (r"\bgh[opsur]_[A-Za-z0-9]{36,}", ""),
    "slack": (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", ""),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", ""),
}


def _spans_sql(rank: int, kind: str, rx: str) -> str:
    """(doc_id, rank, kind, start, stop, v) of all matches in texts(doc_id, t), from the lengths of the
    matches and of what stands between them; doc_id is a key there."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(v) AS stop, v FROM (
      SELECT doc_id, v, sum(length(p)) OVER w + coalesce(sum(length(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
      FROM (SELECT doc_id, unnest(m) AS v, unnest(list_slice(string_split_regex(t, '{rx}'), 1, len(m))) AS p, generate_subscripts(m, 1) AS i
            FROM (SELECT doc_id, t, regexp_extract_all(t, '{rx}') AS m FROM texts) WHERE len(m) > 0)
      WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


_TEXTS = "texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(0, length({_DIGITS}) - 1), lambda i: CASE WHEN i % 2 = 0 THEN substr({_DIGITS}, length({_DIGITS}) - i, 1)::BIGINT ELSE (2 * substr({_DIGITS}, length({_DIGITS}) - i, 1)::BIGINT - CASE WHEN substr({_DIGITS}, length({_DIGITS}) - i, 1)::BIGINT > 4 THEN 9 ELSE 0 END) END)) % 10 = 0"
_IBAN = "replace(v, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END)), lambda a, d: (a * (CASE WHEN d > 9 THEN 100 ELSE 10 END) + d) % 97) = 1"
#: Kinds of personal data in RE2's dialect: pattern, what confirms a match, words, score, boost.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "e-?mail|contact|write|mailto", 0.9, 0.1),
    "ip": (r"[0-9]+(?:\.[0-9]+){3}", rf"regexp_full_match(v, '{_PART}(?:\.{_PART}){{3}}')", r"\bip\b|address|host|server|login", 0.7, 0.2),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END", "card|visa|master|amex|credit|debit|payment", 0.8, 0.2),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", r"phone|tel\b|call|mobile|fax|whatsapp", 0.8, 0.2),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", f"CASE WHEN length({_IBAN}) BETWEEN 15 AND 34 THEN {_MOD97} ELSE false END", "iban|account|bank|konto|compte|cuenta", 0.8, 0.2),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true", r"\bssn\b|social\s+security", 0.2, 0.6),
    "local_phone": (r"\b[0-9]{3}[\x20.-][0-9]{3}[.-][0-9]{4}\b", "true", r"phone|tel\b|call|mobile|fax|whatsapp", 0.3, 0.5),
}


def _pii_sql() -> str:
    parts = []
    for rank, (kind, (rx, confirmed, words, base, boost)) in enumerate(_KINDS.items()):
        near = "substr(t, greatest(start - 48, 0)::BIGINT + 1, (start - greatest(start - 48, 0))::BIGINT) || ' ' || substr(t, stop::BIGINT + 1, 48)"
        score = f"{base}::DOUBLE + CASE WHEN regexp_matches({near}, '(?i){words}') THEN {boost}::DOUBLE ELSE 0::DOUBLE END"
        least = 0.5 if rank > 3 else 0
        parts.append(f"SELECT * FROM (SELECT m.*, {score} AS score FROM ({_spans_sql(rank, kind, rx)}) m JOIN texts USING (doc_id) WHERE {confirmed}) WHERE score >= {least}")
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in list(_KINDS)[:4])
    return f"""WITH {_TEXTS}, found AS ({' UNION ALL '.join(parts)})
      SELECT t.doc_id, {counts}, sha256({joined.format('rank < 4')}) AS base_sha256, {joined.format('kind IS NOT NULL')} AS spans, max(score) AS top_score
      FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id GROUP BY t.doc_id"""


def _secrets_sql() -> str:
    parts = []
    for rank, (kind, (rx, keep)) in enumerate(_RULES.items()):
        parts.append(f"SELECT * FROM ({_spans_sql(rank, kind, rx)}) WHERE regexp_matches(v, '{keep}')")
    joined = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH {_TEXTS}, found AS ({' UNION ALL '.join(parts)})
      SELECT t.doc_id, {counts}, sha256({joined.format('rank < 3')}) AS base_sha256, {joined.format('kind IS NOT NULL')} AS spans, any_value(sha256(t.t)) AS blob
      FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id GROUP BY t.doc_id"""


#: Failures of the five filters by document; every order of them as five rows; what each order does.
_AUDIT = r"""WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
      'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
      'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
      'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
    FROM words LEFT JOIN label USING (doc_id)),
  letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS o FROM letter a, letter b, letter d, letter e, letter g
    WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
  steps AS (SELECT o, s, o[s] AS c FROM orders, range(1, 6) r(s)),
  seen AS (SELECT part, o, s, c, good, toxic, f[c] AS fails, len(list_filter(string_split(o[:s - 1], ''), lambda x: x <> '' AND f[x])) > 0 AS gone,
      len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x])) AS n FROM failed, steps),
  told AS (SELECT part, o AS filter_order, s::INTEGER AS step, c, count(*) FILTER (NOT fails AND NOT gone) AS kept, count(*) FILTER (fails AND NOT gone) AS removed,
      count(*) FILTER (fails AND gone) AS redundant, count(*) FILTER (fails AND n = 1) AS unique_fails,
      count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost FROM seen GROUP BY ALL)
  SELECT * EXCLUDE (c), (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM told"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RANKED = rf"""WITH asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
  lists AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS l FROM documents WHERE regexp_matches(text, '{_TERM}')),
  total AS (SELECT count(*)::BIGINT AS docs, sum(len(l))::BIGINT AS terms FROM lists),
  posting AS (SELECT doc_id, term, count(*)::BIGINT AS tf, any_value(n) AS n FROM (SELECT doc_id, len(l)::BIGINT AS n, unnest(l) AS term FROM lists) GROUP BY doc_id, term),
  weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term),
  scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
    FROM asked JOIN posting USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id),
  ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
  SELECT * FROM ranked WHERE rank <= 50"""


#: All pairs that share a shingle, counted; then what links reach.
_JACCARD = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
  size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
  common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
  SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(other)) AS component_id
  FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can tell; the others are held against plain Python versions in tests/llm."""
    return {"op8_pii": _pii_sql(), "op9_secrets": _secrets_sql(), "op11_filter_audit": _AUDIT, "op12_ranked_search": _RANKED, "op13_jaccard_join": _JACCARD}
