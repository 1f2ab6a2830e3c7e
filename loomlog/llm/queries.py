"""The registered queries of this subpackage: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import UPPER, documents, shared_path


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark, sf_dir, key="example key: production passes its own"):
    from .pii_surrogates import pseudonymise

    return pseudonymise(documents(spark, sf_dir), key)


def op2_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir))


def op3_sentencepiece(spark, sf_dir):
    from .sentencepiece_bpe import encode

    return encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), digests=True)


def op6_ngram_join(spark, sf_dir):
    from .ngram_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op7_token_counts(spark, sf_dir):
    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op4_secrets(spark, sf_dir):
    from .secrets import scan

    return scan(documents(spark, sf_dir))


def op5_quality(spark, sf_dir):
    """Grades: 0 for low quality, 1 for good but toxic, 2 for good and clean; selected: probably better than 0."""
    from .quality_ordinal import fit_quality, rate

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic")).alias("grade"))
    return rate(docs, fit_quality(docs, ratings))


def op8_decontamination(spark, sf_dir):
    from .decontamination import find_leaks

    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language_id(spark, sf_dir):
    from .language_id import fit_language_model, identify

    docs = documents(spark, sf_dir)
    return identify(docs, fit_language_model(docs, tokenizer_path("piece_bpe_32k.model")))


def op10_toxicity(spark, sf_dir):
    from .toxicity_crf import fit_toxicity, score

    docs = documents(spark, sf_dir)
    return score(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_token_shards(spark, sf_dir):
    from .token_shards import read_documents, write_shards

    path = shared_path(spark, "token-shards")
    write_shards(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), path)
    return read_documents(spark, path, content=False)


def op12_conversation_repair(spark, sf_dir):
    from .conversation_repair import damaged, repair

    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), present="here")


def op13_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pii, op2_exact_dedup, op3_sentencepiece, op4_secrets, op5_quality, op6_ngram_join, op7_token_counts, op8_decontamination, op9_language_id, op10_toxicity, op11_token_shards, op12_conversation_repair, op13_collocations)}

ORACLE_SQL = {
    "op2_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)
    """,
    "op6_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                                                  ELSE list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
             n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT u, v FROM p JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.size + y.size - shared)),
             e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
             r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v)
        SELECT node AS doc_id, coalesce(max(size), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node
    """,
    "op13_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
             w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
             s AS (SELECT lang, words, m, unnest(generate_series(1, len(words) - m + 1)) AS i FROM w, generate_series(1, 5) AS x(m) WHERE len(words) >= m),
             f AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL),
             t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
             c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND a >= 100),
             h AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.lang = c.lang AND b.m > c.m AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
             k AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM h),
             q AS (SELECT k.lang, k.phrase, k.k, k.a, x.a AS l, y.a AS r, n, ((1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
                   FROM k JOIN t ON t.lang = k.lang JOIN f AS x ON x.lang = k.lang AND x.phrase = array_to_string(k.words[1:k], ' ') JOIN f AS y ON y.lang = k.lang AND y.phrase = array_to_string(k.words[k + 1:], ' ')),
             o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM q),
             z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o WHERE nth = 1)
        SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000
    """,
}
