"""The queries of this subpackage, by name, and the SQL of those that SQL can express.

The ten operators have columns that SQL cannot compute. What it can compute of them is queried apart, through the same
operators, and held against SQL.
"""

from __future__ import annotations

from . import chunking, collocations, decontam, licenses, linededup, neardup, ngramjoin, pieces, private, quality, secrets, tokencounts, wordruns

QUERIES = (
    chunking.op1_payload_chunks,
    neardup.op2_super_minhash,
    decontam.op3_template_windows,
    secrets.op4_secret_names,
    licenses.op5_winnowed_licenses,
    pieces.op6_piece_spans,
    linededup.op7_deletion_neighbours,
    private.op8_bootstrapped_contexts,
    tokencounts.op9_section_tokens,
    quality.op10_random_indexing,
    ngramjoin.op11_ngram_join,
    wordruns.op12_word_runs,
    collocations.op13_collocations,
)


def payload_digests(spark, sf_dir: str):
    """Of op1: sizes and digests of the payloads that were read back."""
    return chunking.op1_payload_chunks(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def shingle_counts(spark, sf_dir: str):
    """Of op2: the size of each text's set."""
    return neardup.op2_super_minhash(spark, sf_dir).select("doc_id", "n_shingles")


def secret_counts(spark, sf_dir: str):
    """Of op4: the fixed patterns."""
    return secrets.op4_secret_names(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def private_counts(spark, sf_dir: str):
    """Of op8: the fixed patterns."""
    return private.op8_bootstrapped_contexts(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


PARTS = (payload_digests, shingle_counts, secret_counts, private_counts)

TEXT = "coalesce(text, '')"
SIZE = f"octet_length(encode({TEXT}))"
PAYLOAD = f"greatest(1, ceil({SIZE} / 192.0))::BIGINT * 192"
LOW = f"translate({TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: A word of the fixed patterns of op4 with its letters in either case.
EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))


def found(pattern: str, holds: str, group: int = 0) -> str:
    """SQL: how many matches m of a pattern hold."""
    pattern = pattern.replace("'", "''")
    return f"len(list_filter(regexp_extract_all({TEXT}, '{pattern}', {group}), lambda m: {holds}))::BIGINT"


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = (
    f"list_sum(list_transform(range(length({DIGITS})), lambda i: CASE WHEN (length({DIGITS}) - i) % 2 = 1 THEN substr({DIGITS}, i + 1, 1)::INT "
    f"WHEN substr({DIGITS}, i + 1, 1)::INT > 4 THEN 2 * substr({DIGITS}, i + 1, 1)::INT - 9 ELSE 2 * substr({DIGITS}, i + 1, 1)::INT END)) % 10 = 0"
)
#: op13 from its definition: every phrase is counted, whether frequent or not.
COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS sizes(k) WHERE len(w) >= k),
counts AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS a FROM spans GROUP BY ALL),
sums AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND a >= 100),
inside AS (SELECT DISTINCT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, a AS longer FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM candidates, range(2, 5) AS sizes(s) WHERE s < k)),
kept AS (SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.longer >= 100 * c.a)),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN sums USING (lang) JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.j], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1 :], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= 2000
"""
ORACLES = {
    "op13_collocations": COLLOCATIONS,
    "payload_digests": f"SELECT doc_id, {SIZE}::BIGINT AS n_bytes, {PAYLOAD} AS payload_bytes, sha256({TEXT} || repeat(' ', ({PAYLOAD} - {SIZE})::INT)) AS payload_sha256 FROM documents",
    "shingle_counts": (
        rf"WITH w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents) "
        "SELECT doc_id, CASE WHEN len(w) < 4 THEN least(len(w), 1) ELSE len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END::BIGINT AS n_shingles FROM w"
    ),
    "secret_counts": (
        f"""SELECT doc_id, {found(f'''({EITHER})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)''', 'length(m) >= 6', 2)} AS n_assign, """
        f"{found('AKIA[A-Z0-9]+', 'length(m) >= 20')} AS n_access, {found('[0-9a-f]+', 'length(m) >= 24')} AS n_hex FROM documents"
    ),
    "private_counts": (
        f"SELECT doc_id, {found(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')} AS n_email, "
        f"{found('[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', 'list_max(list_transform(string_split(m, chr(46)), lambda p: p::HUGEINT)) <= 255')} AS n_ip, "
        f"{found('[0-9](?:[ -]?[0-9])+', f'length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}')} AS n_card, "
        f"{found('[+][0-9][ ().0-9-]+[0-9]', f'length({DIGITS}) BETWEEN 8 AND 15')} AS n_phone FROM documents"
    ),
}


def queries():
    return {f.__name__: f for f in (*QUERIES, *PARTS)}


def oracle_sql():
    return dict(ORACLES)
