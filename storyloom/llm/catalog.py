"""Registered queries of this package and the SQL that checks them, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.exact_dedup import exact_groups
from storyloom.llm.fingerprints import fingerprints
from storyloom.llm.language_id import fit, predict
from storyloom.llm.line_templates import drop_recurring_lines
from storyloom.llm.merkle_manifest import audit, manifest
from storyloom.llm.near_dedup import near_components
from storyloom.llm.packing import pack_documents
from storyloom.llm.piece_transducer import round_trips
from storyloom.llm.secret_scan import scan, span_digests
from storyloom.llm.spelling_variants import frequent_words, lowered_runs, spelling_groups, thinned
from storyloom.llm.substring_dedup import drop_repeated_passages
from storyloom.llm.suffix_dedup import drop_repeated_bytes
from storyloom.llm.warc import archive_pages
from storyloom.plans.registry import Query
from storyloom.scratch import new_path

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_exact_dedup",
    f"""
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, {_LOWERED} AS t FROM documents) WINDOW g AS (PARTITION BY t)
    """,
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder), keep="largest")


@query(
    "op10_near_dedup",
    f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingles AS (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 5
            THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
    reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT links.a, reach.other FROM reach JOIN links ON links.b = reach.doc_id),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM least LEFT JOIN sizes USING (doc_id)
    """,
)
def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(documents(spark, folder))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), tokenizer_path())


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return span_digests(scan(documents(spark, folder)))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, fit(docs))


@query(
    "op7_substring_dedup",
    r"""
    WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
        SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM texts)),
    firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
    covered AS (
        SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM windows JOIN firsts USING (h) WHERE doc_id > least),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
    kept AS (
        SELECT doc_id, count(covered.i) AS n, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (covered.i IS NULL), '') AS t
        FROM words LEFT JOIN covered USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
    """,
)
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_passages(documents(spark, folder)).drop("removed")


# The base 32 digits of a SHA-1, five bits at a time from two of its hexadecimal digits.
_HEX = "(strpos('0123456789abcdef', substr(h || '0', (5 * i) // 4 + {}, 1)) - 1)"
_BASE32 = f"""
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((16 * {_HEX.format(1)} + {_HEX.format(2)})::INT >> (3 - (5 * i) % 4)::INT) & 31), 1)), 'string_agg', '')"""


@query(
    "op6_warc",
    f"""
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    judged AS (SELECT page_id, t, h, max(page_id) OVER (PARTITION BY t) AS top FROM payloads)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to
    FROM judged
    """,
)
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    read = archive_pages(pages, new_path(spark, "warc"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(documents(spark, folder))


@query(
    "op3_line_dedup",
    r"""
    WITH lines AS (
        SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS no
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
    masked AS (
        SELECT doc_id, t, line, no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
            lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM lines),
    leaves AS (SELECT *, {'n': len(w), 'lead': w[1:3]} AS leaf FROM masked WHERE len(w) > 0),
    common AS (SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT t) >= 10),
    held AS (SELECT leaves.* FROM leaves JOIN common USING (leaf)),
    kinds AS (SELECT leaf, w, count(DISTINCT t) AS texts FROM held GROUP BY leaf, w),
    tokens AS (SELECT leaf, w, texts, unnest(w) AS token, unnest(range(len(w))) AS place FROM kinds),
    support AS (
        SELECT leaf, token, place, length(bin((sum(texts) // 10)::BIGINT)) AS level FROM tokens WHERE place >= 3 AND token <> '<*>'
        GROUP BY leaf, token, place HAVING sum(texts) >= 10),
    levels AS (
        SELECT leaf, w, list(CASE WHEN place < 3 THEN 99 ELSE coalesce(level, 0) END ORDER BY place) AS v
        FROM tokens LEFT JOIN support USING (leaf, token, place) GROUP BY leaf, w),
    reached AS (SELECT leaf, w, v, unnest(list_distinct(list_filter(v, lambda x: x BETWEEN 1 AND 98))) AS least FROM levels),
    general AS (SELECT leaf, w, [CASE WHEN v[i] >= least THEN w[i] ELSE '<*>' END FOR i IN range(1, len(w) + 1)] AS g FROM reached),
    alike AS (
        SELECT leaf, w, g FROM general WHERE len(list_filter(g, lambda x: x <> '<*>')) >= 0.5 * len(g)
        AND len(list_filter(g[4:], lambda x: x <> '<*>')) >= 0.5 * len(list_filter(w[4:], lambda x: x <> '<*>'))),
    templates AS (SELECT leaf, w, g FROM alike UNION SELECT leaf, w, w FROM kinds),
    recurring AS (SELECT leaf, g FROM templates JOIN held USING (leaf, w) GROUP BY leaf, g HAVING count(DISTINCT t) >= 10),
    gone AS (
        SELECT DISTINCT doc_id, no FROM held JOIN (SELECT DISTINCT leaf, w FROM templates JOIN recurring USING (leaf, g)) USING (leaf, w))
    SELECT doc_id, count(*) AS n_lines, count(gone.no) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (gone.no IS NULL), '')) AS kept_sha256
    FROM lines LEFT JOIN gone USING (doc_id, no) GROUP BY doc_id
    """,
)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = drop_recurring_lines(documents(spark, folder))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return round_trips(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


# The unsigned crc32 of a list of bytes, by its table of 256 remainders.
_CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x & 1 = 1
    THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc_t FROM range(256) r(i))"""


def _crc32(bytes_: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295], {bytes_}), lambda c, b:
        xor(c >> 8, crc_t[xor(c & 255, b) + 1])), 4294967295)"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree_sql(start: str, tree: str, levels: int = 6) -> str:
    """Levels of 16-ary trees over ``start`` (g, i, h, n), and for each of its nodes the siblings and the folded hash."""
    parts = [f"{tree}0 AS (SELECT g, i, h, n FROM {start})"]
    for k in range(levels):
        parts.append(f"""{tree}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h,
            any_value((n + 15) // 16) AS n, string_agg(h, '' ORDER BY i) AS run FROM (SELECT g, i, h, n FROM {tree}{k}) GROUP BY g, i // 16)""")
    return ", ".join(parts)


def _climb_sql(rows: str, tree: str, out: str, levels: int = 6) -> str:
    """``rows`` (g, i, proof, node) folded upwards through the levels of ``tree``."""
    parts = [f"{out}0 AS (SELECT * FROM {rows})"]
    for k in range(levels):
        at = f"64 * ((r.i // {16**k}) % 16)"
        left, right = f"substr(u.run, 1, {at})", f"substr(u.run, {at} + 65)"
        parts.append(f"""{out}{k + 1} AS (SELECT r.* REPLACE (CASE WHEN d.n > 1 THEN r.proof || {left} || {right} ELSE r.proof END AS proof,
            CASE WHEN d.n > 1 THEN sha256({left} || r.node || {right}) ELSE r.node END AS node)
            FROM {out}{k} r JOIN {tree}{k + 1} u ON u.g = r.g AND u.i = r.i // {16 ** (k + 1)} JOIN {tree}{k} d ON d.g = r.g AND d.i = r.i // {16**k})""")
    return ", ".join(parts)


_LOWERED_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_merkle_manifest",
    f"""
    WITH {_CRC_TABLE},
    marks AS (SELECT doc_id, {_crc32("list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j::INT, 1)))")} % 5 = 0 AS hit FROM documents, crc_table),
    leaves AS (
        SELECT doc_id, coalesce('=' || source, '-') AS g, source, {_leaf_sql('text')} AS h, CASE WHEN hit THEN {_leaf_sql(_LOWERED_TEXT)} ELSE {_leaf_sql('text')} END AS seen
        FROM documents JOIN marks USING (doc_id)),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
    {_tree_sql('placed', 'a')},
    subs AS (
        SELECT '' AS g, a6.g AS tree, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, a6.h, count(*) OVER () AS n
        FROM a6 JOIN (SELECT g, any_value(source) AS s FROM leaves GROUP BY g) USING (g)),
    {_tree_sql('subs', 'b')},
    low AS (SELECT doc_id, g, i, h AS leaf, '' AS proof, seen AS node FROM placed),
    {_climb_sql('low', 'a', 'c')},
    mid AS (SELECT c6.doc_id, '' AS g, subs.i, c6.leaf, subs.h AS subroot, c6.proof, c6.node FROM c6 JOIN subs ON subs.tree = c6.g),
    {_climb_sql('mid', 'b', 'd')}
    SELECT doc_id, leaf, subroot, b6.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = b6.h AS verified FROM d6, b6
    """,
)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return audit(manifest(docs, altered={"text": _lower_ascii}, altered_where=tampered))


def _lower_ascii(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# The UTF-8 bytes of letters up to U+00FF and of digits and the colon.
_RUN_BYTES = """flatten(list_transform(range(1, length(s) + 1), lambda j: CASE WHEN unicode(substr(s, j::INT, 1)) < 128
    THEN [unicode(substr(s, j::INT, 1))::BIGINT] ELSE [195, unicode(substr(s, j::INT, 1))::BIGINT - 64] END))"""


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE {_CRC_TABLE},
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
    lowered AS (
        SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM runs WHERE length(r) >= 7 GROUP BY 1, 2),
    hashed AS (SELECT r, c, doc_id || ':' || r AS s FROM lowered),
    keyed AS (SELECT r, c, {_crc32(_RUN_BYTES)} AS h FROM hashed, crc_table),
    thin AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, c FROM keyed),
    words AS (SELECT word, sum(c)::BIGINT AS n FROM thin WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    cuts AS (
        SELECT word, n, unnest(range(0, length(word) + 1)) AS j FROM words),
    parts AS (SELECT word, n, j, CASE WHEN j = 0 THEN word ELSE substr(word, 1, j::INT - 1) || substr(word, j::INT + 1) END AS v FROM cuts),
    pairs AS (
        SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM parts a JOIN parts b USING (v)
        WHERE a.word <> b.word AND (a.j = b.j OR a.j * b.j = 0)),
    best AS (
        SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM pairs GROUP BY word),
    judged AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
        FROM words LEFT JOIN best USING (word)),
    chain AS (
        SELECT word, word AS last, 0 AS step FROM judged
        UNION ALL SELECT chain.word, judged.form, step + 1 FROM chain JOIN judged ON judged.word = chain.last WHERE judged.form IS NOT NULL)
    SELECT word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word) USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups(frequent_words(thinned(lowered_runs(documents(spark, folder)))))


@query("op13_suffix_dedup")
def op13_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_bytes(documents(spark, folder)).drop("removed")
