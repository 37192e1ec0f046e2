"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timetab.llm.byte_bpe import bpe_encode, decode, read_ranks
from timetab.llm.code_compression import ENTRIES, PARTS, ROUNDS, compress, digest
from timetab.llm.exact_dedup import exact_dedup
from timetab.llm.filter_audit import filter_audit
from timetab.llm.importance import importance_sample
from timetab.llm.language_id import identify_languages
from timetab.llm.max_score import top_k
from timetab.llm.ngram_join import ngram_components
from timetab.llm.packing import pack_documents
from timetab.llm.quality_rules import CONFIDENCE_LOSS, RISK, RULES, joint_levels, quality_verdicts
from timetab.llm.substring_dedup import substring_dedup
from timetab.llm.suffix_dedup import suffix_dedup
from timetab.llm.warc import page_of, read_warc, write_warc
from timetab.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LEAST_REVISIT = 1000
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    """Register a query under its function name, and its SQL twin."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))
                                            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
    reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN links ON x = doc_id)
    SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""")
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return ngram_components(table(spark, sf_dir, "documents"))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three residues of the hashed id."""
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    out = identify_languages(docs, learn_from=part != 1, order=F.xxhash64("doc_id"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
           sha256(body) AS text_sha256
    FROM (SELECT doc_id, {LOWER_SQL} AS body FROM documents) WINDOW same AS (PARTITION BY body)
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every group of equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@query(f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL} AS words FROM documents),
    n AS (SELECT doc_id, words, len(words) AS n FROM w),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, n - 33)) AS i FROM n WHERE n >= 35)
    ),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM windows) WHERE c > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM twice),
    lost AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
    SELECT n.doc_id, n AS n_words, coalesce(len(places), 0) AS n_removed,
           sha256(array_to_string(
               CASE WHEN places IS NULL THEN words
                    ELSE list_transform(list_filter(list_zip(words, range(1, n + 1)), lambda z: NOT list_contains(places, z[2])), lambda z: z[1]) END,
               ' ')) AS kept_sha256
    FROM n LEFT JOIN lost USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when passages of 35 words that occur more than once are removed."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
                 max(page_id) OVER (PARTITION BY body) AS last FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last THEN last END AS refers_to
    FROM d
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path, least_bytes=LEAST_REVISIT)
    back = read_warc(spark, path, with_payload=False).where("status = 'record'")
    return back.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page_of(F.col("refers_to")).alias("refers_to"),
    )


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes that they decode to."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )


def _quality_sql() -> str:
    levels = " UNION ALL ".join(
        f"SELECT {i} AS nth, " + ", ".join(f"{cut!r}::DOUBLE AS cut_{rule}" for rule, cut in level.items()) for i, level in enumerate(joint_levels(RULES))
    )
    values = ", ".join(f"({value})::DOUBLE AS {rule}" for rule, (value, _) in RULES.items())
    beyond = " OR ".join(f"coalesce({rule} > cut_{rule}, false)" for rule in RULES)
    return f"""
        WITH w AS (
            SELECT doc_id, lang AS stratum, coalesce(text, '') AS body, {WORDS_SQL} AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
        ),
        grams AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
            FROM (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
                  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w))
        ),
        again AS (
            SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS spot FROM grams WHERE times > 1) GROUP BY doc_id
        ),
        counted AS (
            SELECT doc_id, coalesce(stratum, '') AS stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                   length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words
            FROM w LEFT JOIN again USING (doc_id)
        ),
        base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
        valued AS (SELECT *, {values} FROM base WHERE NOT base_failed),
        levels AS ({levels}),
        good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
        tested AS (
            SELECT stratum, nth, count(*) AS n, count(*) FILTER (WHERE {beyond}) AS k
            FROM valued, levels WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
        ),
        bounded AS (
            SELECT stratum, nth, n, CASE WHEN k >= n * {RISK!r} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
                exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK!r}) + (n - i) * ln(1 - {RISK!r})))) END AS p
            FROM tested
        ),
        sizes AS (
            SELECT stratum, r, r - floor(least({CONFIDENCE_LOSS!r} / greatest(pow(1 - {RISK!r}, n), 1e-300), 1e9)) AS short
            FROM (SELECT stratum, n, row_number() OVER (ORDER BY n, stratum) AS r FROM bounded WHERE nth = 0)
        ),
        worst AS (SELECT stratum, r, max(short) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS short FROM sizes),
        family AS (SELECT stratum FROM worst WHERE r >= (SELECT min(r) FROM worst WHERE short <= r - 1)),
        holm AS (
            SELECT *, p <= {CONFIDENCE_LOSS!r} / (count(*) OVER (PARTITION BY nth) - row_number() OVER (PARTITION BY nth ORDER BY p, stratum) + 1) AS ok
            FROM bounded WHERE stratum IN (SELECT stratum FROM family)
        ),
        passed AS (SELECT *, bool_and(ok) OVER (PARTITION BY nth ORDER BY p, stratum) AS safe FROM holm),
        chosen AS (
            SELECT stratum, max(nth) AS nth FROM passed
            WHERE safe AND nth <= (SELECT coalesce(min(nth) FILTER (WHERE NOT safe), 1000) FROM passed) GROUP BY stratum
        ),
        out AS (SELECT DISTINCT doc_id FROM valued JOIN chosen USING (stratum) JOIN levels USING (nth) WHERE {beyond})
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM out) AS kept
        FROM base
    """


@query(_quality_sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and rules with risk-controlled cutoffs per language."""
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as spec:
        return pack_documents(table(spark, sf_dir, "documents"), spec.read())


@query()
def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by their likeness to labelled good ones."""
    wanted = table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return importance_sample(table(spark, sf_dir, "documents"), wanted)


@query("""
    WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS body, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
    strings AS (SELECT doc_id, i, md5(substring(body, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, body, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM strings) WHERE c > 1),
    steps AS (
        SELECT doc_id, i, lead(i) OVER own AS later, i > coalesce(lag(i) OVER own, -1000) + 400 AS opens FROM twice WINDOW own AS (PARTITION BY doc_id ORDER BY i)
    ),
    counted AS (SELECT doc_id, sum(least(400, coalesce(later - i, 400)))::BIGINT AS n_removed, count(*) FILTER (WHERE opens) AS n_spans FROM steps GROUP BY doc_id),
    runs AS (
        SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (
            SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps
        ) GROUP BY doc_id, run
    ),
    holes AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id),
    left_over AS (
        SELECT h.doc_id, string_agg(substring(body, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept FROM holes h JOIN d USING (doc_id) GROUP BY h.doc_id
    )
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, body))) AS kept_sha256
    FROM d LEFT JOIN counted USING (doc_id) LEFT JOIN left_over USING (doc_id)
""")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left when strings of 400 bytes that occur more than once are removed."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


SOUND_SQL = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql() -> str:
    def coded(r: int) -> str:
        return f"""
        near{r} AS MATERIALIZED (
            SELECT vec_id, part, entry, d FROM (
                SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM cells c JOIN book{r} b USING (part, place) GROUP BY ALL
            ) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
        )"""

    rounds = "".join(f"""{coded(r)},
        book{r + 1} AS MATERIALIZED (
            SELECT part, entry, place, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
                SELECT part, entry, place, floor(sum(x) / count(*))::BIGINT AS x FROM cells JOIN near{r} USING (vec_id, part) GROUP BY ALL
            ) m USING (part, entry, place)
        ),""" for r in range(ROUNDS))
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {SOUND_SQL}
        ),
        cells AS MATERIALIZED (
            SELECT vec_id, d // (len(v) // {PARTS}) AS part, d % (len(v) // {PARTS}) AS place, v[d + 1] AS x
            FROM (SELECT vec_id, v, unnest(range(len(v))) AS d FROM kept)
        ),
        book0 AS MATERIALIZED (
            SELECT part, entry, place, x FROM cells JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}
            ) USING (vec_id)
        ),{rounds}{coded(ROUNDS)},
        codes AS (
            SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
            FROM near{ROUNDS} JOIN kept USING (vec_id) GROUP BY vec_id, label
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
        FROM codes
    """


@query(_codes_sql())
def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors and the codebooks' digest."""
    coded, book = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


@query(f"""
    WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {SOUND_SQL}),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM kept q JOIN kept c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 20
""")
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows, by integer inner product, of every twentieth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _audit_sql() -> str:
    letters = "ABCDE"
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(letters))
    alone = " ".join(f"WHEN '{f}' THEN fails = {1 << i}" for i, f in enumerate(letters))
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, {WORDS_SQL} AS words FROM documents),
        flagged AS (
            SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                   + 4 * (100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body))::INT
                   + 8 * regexp_matches(body, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY body))::INT AS fails
            FROM d
        ),
        marked AS (
            SELECT part, fails, l.good IS TRUE AS good, l.toxic IS TRUE AS toxic
            FROM flagged LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
        ),
        counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM marked GROUP BY ALL),
        orders AS (SELECT * FROM (VALUES {orders}) t(filter_order)),
        steps AS (
            SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS own,
                   list_sum(list_transform(string_split(filter_order[1 : step - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE 1 << (ascii(c) - 65) END)) AS before
            FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step)
        ),
        out AS (
            SELECT part, filter_order, step, letter,
                   coalesce(sum(n) FILTER (WHERE (fails & (before | own)) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (WHERE (fails & before) = 0 AND (fails & own) > 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (WHERE (fails & before) > 0 AND (fails & own) > 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (WHERE CASE letter {alone} END), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (WHERE (fails & before) = 0 AND (fails & own) > 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(toxic) FILTER (WHERE (fails & before) = 0 AND (fails & own) > 0), 0)::BIGINT AS toxic_lost
            FROM steps, counted GROUP BY ALL
        )
        SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM out
    """


@query(_audit_sql())
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, in every order."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
