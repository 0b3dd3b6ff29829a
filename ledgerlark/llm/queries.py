"""The numbered queries over whole tables, and their SQL where SQL can express them."""

import public_tokenizers

from ledgerlark.llm import audits, factors, metric_join, minhash, mixing, packing, runs, sharding, token_counts, token_store, topk, toxicity, wrappers
from ledgerlark.llm.common import table
from ledgerlark.plans import lineage

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
END_ID = 1


def op1_metric_join(spark, sf_dir):
    """Near-duplicate vectors at cosine 0.9."""
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op2_token_store(spark, sf_dir):
    """Token files written and read back."""
    folder = lineage.scratch_path(spark, "token-files")
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_VOCABULARY), END_ID)
    return token_store.read_tokens(manifest)


def op3_toxicity(spark, sf_dir):
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark, sf_dir):
    """Documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), END_ID)


def op5_minhash(spark, sf_dir):
    """Near-duplicate groups by two-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_token_counts(spark, sf_dir):
    """Tokens of every document under a unigram reading of the piece vocabulary."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


#: Weights of the domains in the mixture.
TARGETS = {"low": 0.05, "clean": 0.9, "toxic": 0.05}


def op7_mixing(spark, sf_dir):
    """Rates of all documents for the target weights."""
    return mixing.mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op8_wrappers(spark, sf_dir):
    """The main text of every page."""
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op9_topk(spark, sf_dir):
    """The ten highest integer products of every hundredth vector."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), 10, 100, 1024)


def op10_sharding(spark, sf_dir):
    """Documents in 16 shards of nearly equal bytes."""
    return sharding.kd_shards(table(spark, sf_dir, "documents"), 16)


def op11_runs(spark, sf_dir):
    """Periodic runs of words in every document."""
    return runs.run_table(table(spark, sf_dir, "documents"))


def op12_audits(spark, sf_dir):
    """Cheapest repair of every damaged conversation."""
    return audits.audits(table(spark, sf_dir, "conversations"))


def op13_factors(spark, sf_dir):
    """Every document without passages of 50 bytes that stand in earlier ones."""
    return factors.without_repeats(table(spark, sf_dir, "documents"), 50)


def all_queries():
    return {name: query for name, query in globals().items() if name.startswith("op")}


#: Vectors that can be compared, as doubles.
_WHOLE = """
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
"""

SQL = {
    "op1_metric_join": f"""
        WITH RECURSIVE whole AS ({_WHOLE}),
        usable AS (SELECT * FROM whole WHERE list_inner_product(v, v) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ),
        reached(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
        ),
        components AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
        counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM components LEFT JOIN counts USING (vec_id)
    """,
    "op5_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'
            ), lambda x: x <> '') AS w FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s
            FROM words
        ),
        shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ),
        reached(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION
            SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
        ),
        components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN components USING (doc_id)
    """,
    "op9_topk": f"""
        WITH whole AS ({_WHOLE}),
        numbers AS (SELECT vec_id, list_transform(v, lambda x: floor(1024 * x)) AS v FROM whole),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM numbers q JOIN numbers c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
}


def _crc32(text):
    """The unsigned crc32 of ASCII text, bit by bit."""
    eight = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {eight}), 4294967295)"


def _edit(best, cost, edit):
    """Strings of a cost in nine digits and the edits: one more edit."""
    return f"lpad(CAST(left({best}, 9)::INTEGER + {cost} AS VARCHAR), 9, '0') || substr({best}, 10) || '{edit}'"


def _edits(edit, *bests, when="NOT gone"):
    cost = {"K": "cut", "R": "2 + cut", "D": "3", "I": "2"}[edit]
    return ", ".join(f"CASE WHEN {when} THEN {_edit(best, cost, edit)} END" for best in bests)


SQL["op11_runs"] = rf"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ),
    sized AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts FROM texts),
    changed AS (
        SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
            THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // parts) + 1] END) ELSE w END AS w
        FROM sized
    ),
    words AS (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM changed),
    pairs AS (
        SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
    ),
    islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
    stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island),
    runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
    longest AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS place FROM runs),
    listed AS (
        SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY r
    ),
    dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
        sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM changed LEFT JOIN (SELECT * FROM longest WHERE place = 1) USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

SQL["op12_audits"] = rf"""
    WITH RECURSIVE read AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate FROM conversations
    ),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
            CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM read
    ),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
    judged AS (
        SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
            NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair
        FROM numbered
    ),
    steps AS (SELECT conv_id, k, role, text, initial, blank OR again AS gone, CASE WHEN open THEN 1 ELSE 0 END AS cut FROM judged),
    edited(conv_id, k, e, s, u, a) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000002I', '000000004II' FROM conversations
        UNION ALL
        SELECT conv_id, k, e, s, u, least(a, {_edit("u", 2, "I")}) FROM (
            SELECT conv_id, k, e, s, a, least(u, {_edit("e", 2, "I")}, {_edit("s", 2, "I")}, {_edit("a", 2, "I")}) AS u FROM (
                SELECT conv_id, steps.k, {_edit("e", 3, "D")} AS e,
                    least({_edit("s", 3, "D")}, {_edits("K", "e", when="NOT gone AND initial = 's'")}) AS s,
                    least({_edit("u", 3, "D")}, {_edits("K", "e", "s", "a", when="NOT gone AND initial = 'u'")}, {_edits("R", "e", "s", "a")}) AS u,
                    least({_edit("a", 3, "D")}, {_edits("K", "u", when="NOT gone AND initial = 'a'")}, {_edits("R", "u")}) AS a
                FROM edited JOIN steps USING (conv_id) WHERE steps.k = edited.k + 1
            )
        )
    ),
    ends AS (
        SELECT conv_id, arg_max(least(e, a), k) AS best, max(k) AS n FROM edited GROUP BY conv_id
    ),
    chosen AS (SELECT conv_id, CASE WHEN n > 0 THEN left(best, 9)::BIGINT ELSE 0 END AS cost, CASE WHEN n > 0 THEN substr(best, 10) ELSE '' END AS audit FROM ends),
    edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS j FROM chosen WHERE audit <> ''),
    placed AS (
        SELECT *, CAST(sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS BIGINT) AS k,
            CAST(sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS BIGINT) - 1 AS t FROM edits
    ),
    filled AS (
        SELECT p.conv_id, p.j, p.t, p.edit, r.role, r.text,
            max(CASE WHEN p.t = 0 AND p.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS opened
        FROM placed p LEFT JOIN steps r ON p.conv_id = r.conv_id AND p.k = r.k AND p.edit <> 'I' WHERE p.edit <> 'D'
    ),
    repaired AS (
        SELECT conv_id, string_agg(
            CASE WHEN edit = 'K' THEN role WHEN (t - opened) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END,
            chr(10) ORDER BY j) AS text FROM filled GROUP BY conv_id
    ),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
            count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank) AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
    )
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(repaired.text, '')) AS repaired_sha256
    FROM chosen LEFT JOIN counted USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

SQL["op13_factors"] = """
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h FROM documents),
    sized AS (SELECT *, octet_length(h) AS n FROM texts),
    strings AS (SELECT r, doc_id, i, array_slice(h, i + 1, i + 50) AS string FROM (SELECT r, doc_id, h, unnest(range(greatest(n - 49, 0))) AS i FROM sized)),
    firsts AS (SELECT string, min(doc_id) AS first FROM strings GROUP BY string),
    starts AS (SELECT r, i FROM strings JOIN firsts USING (string) WHERE first < doc_id),
    marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM starts),
    grouped AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
    spans AS (SELECT r, min(i) AS start, max(i) + 50 AS stop FROM grouped GROUP BY r, span),
    gaps AS (
        SELECT r, start, stop, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS before FROM spans
        UNION ALL SELECT r, n, n, coalesce(max(stop), 0) FROM sized LEFT JOIN spans USING (r) GROUP BY r, n
    ),
    kept AS (SELECT r, string_agg(hex(array_slice(h, before + 1, gaps.start)), '' ORDER BY gaps.start, before) AS h FROM gaps JOIN sized USING (r) GROUP BY r),
    removed AS (SELECT r, CAST(sum(stop - start) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
    FROM sized JOIN kept USING (r) LEFT JOIN removed USING (r)
"""


def all_sql():
    return dict(SQL)
