"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_search, bpe, dart_minhash, jaccard_join, lexical, line_dedup, merkle, mixing, norm_search, pii, quality, sharding, suffix_dedup
from .common import table


def op1_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_search.nearest(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return bpe.digests(coded).drop("ids")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "source", "lang", "topic", "tokens", F.round(F.col("weight") * 1e6, 4).alias("weight_ppm"), F.round("prob", 5).alias("prob"), "sampled", F.round("expected", 5).alias("expected"), "copies")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", "kept_text")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("new_text").alias("text"), "n_replaced", F.array_join("kinds", ",").alias("kinds"))


def op10_norm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_search.highest(table(spark, sf_dir, "embeddings"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raised = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    m = merkle.document_manifest(docs, {"n_chars": raised})
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256")
    return m.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_bit_search, op2_quality, op3_bpe, op4_mixing, op5_line_dedup, op6_dart_minhash, op7_sharding, op8_suffix_dedup, op9_pii, op10_norm_search, op11_jaccard_join, op12_merkle, op13_lexical)}


def _mixing_sql() -> str:
    """Raking as a chain of windows: all sweeps, each over source, language and topic."""
    targets, joins = [], []
    for name, power in mixing.TEMPER.items():
        targets.append(f"t_{name} AS (SELECT {name}, pow(sum(tokens)::DOUBLE, {power}) / sum(pow(sum(tokens)::DOUBLE, {power})) OVER () AS {name}_target FROM cells GROUP BY {name})")
        joins.append(f"JOIN t_{name} USING ({name})")
    steps, last = [], "w0"
    for i in range(mixing.SWEEPS):
        for name in mixing.TEMPER:
            new = f"w{i}_{name}"
            steps.append(f"{new} AS (SELECT * REPLACE (w * {name}_target / sum(w) OVER (PARTITION BY {name}) AS w) FROM {last})")
            last = new
    return f"""WITH d AS (SELECT doc_id, source, lang, text, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS tokens,
        CASE WHEN regexp_matches(text, '[#$%&*!]{{2,}}') THEN 'noise' WHEN regexp_matches(text, '[0-9]') THEN 'figures' WHEN length(text) < 400 THEN 'brief' ELSE 'prose' END AS topic FROM documents),
      cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL),
      {", ".join(targets)},
      w0 AS (SELECT cells.*, {", ".join(f"{n}_target" for n in mixing.TEMPER)}, tokens::DOUBLE AS w FROM cells {" ".join(joins)}),
      {", ".join(steps)},
      c AS (SELECT *, w / tokens AS r, sum(tokens) OVER o AS upto, sum(w) OVER o AS mass, sum(tokens) OVER () AS total, sum(w) OVER () AS whole
        FROM {last} WHERE tokens > 0 WINDOW o AS (ORDER BY w / tokens DESC, lang, source, topic ROWS UNBOUNDED PRECEDING)),
      k AS (SELECT arg_max(f, r) AS f FROM (SELECT r, ({mixing.RATE} * total - (upto - tokens)) / (whole - mass + tokens * r) AS f FROM c) WHERE f * r <= 1 + 1e-12),
      p AS (SELECT source, lang, topic, w / nullif(tokens, 0) AS r, CASE WHEN tokens > 0 THEN {mixing.RATE} * sum(tokens) OVER () * w / sum(w) OVER () / tokens ELSE {mixing.RATE} END AS expected,
        CASE WHEN tokens > 0 THEN least(1.0, f * w / tokens) ELSE {mixing.RATE} END AS prob FROM {last}, k),
      u AS (SELECT *, ('0x' || substr(md5(concat_ws(':', {mixing.SEED}, doc_id, md5(text))), 1, 7))::BIGINT / {1 << 28}::DOUBLE AS drawn FROM d)
      SELECT doc_id, source, lang, topic, tokens, round(coalesce(r, 0) * 1e6, 4) AS weight_ppm, round(prob, 5) AS prob, drawn < prob AS sampled, round(expected, 5) AS expected,
        (floor(expected) + CASE WHEN drawn < expected - floor(expected) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM u JOIN p USING (source, lang, topic)"""


#: Unsigned CRC-32 of a list of byte values b, with the table ``bits`` of one byte's remainders (crc_table).
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {b}), lambda a, x: xor(a >> 8, bits[(xor(a, x) & 255) + 1])))"
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS bits)"""


def _merkle_sql(low: int = 20, high: int = 8) -> str:
    """Each tree's levels as lists, then the leaves' paths, then folding; for up to 2**low rows of a language and 2**high languages."""

    def field(name: str) -> str:
        return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"

    def levels(n: int, first: str, lists: str) -> list[str]:
        up = "CASE WHEN len({v}) > 1 THEN list_transform(range(0, (len({v}) + 1) // 2), lambda i: sha256({v}[2 * i + 1] || coalesce({v}[2 * i + 2], ''))) ELSE {v} END"
        return [f"{lists}{k + 1} AS (SELECT *, {up.format(v=f'v{k}')} AS v{k + 1} FROM {first if k == 0 else f'{lists}{k}'})" for k in range(n)]

    def leaf(chars: str) -> str:
        return "sha256(" + " || ".join([field("doc_id"), field("source"), field("lang"), field(chars), field("text")]) + ")"

    other = "CASE WHEN len({v}) > 1 THEN coalesce({v}[xor({p} >> {k}, 1) + 1], '') ELSE NULL END"
    turn = "CASE WHEN len({v}) = 1 THEN {f} WHEN ({p} >> {k}) & 1 = 1 THEN sha256({v}[xor({p} >> {k}, 1) + 1] || {f}) ELSE sha256({f} || coalesce({v}[xor({p} >> {k}, 1) + 1], '')) END"
    folds = [f"p{k + 1} AS (SELECT *, {turn.format(v=f'v{k}', p='pos', k=k, f=f'f{k}')} AS f{k + 1} FROM p{k})" for k in range(low)]
    tops = [f"q{k + 1} AS (SELECT *, {turn.format(v=f'u{k}', p='place', k=k, f=f'g{k}')} AS g{k + 1} FROM q{k})" for k in range(high)]
    proof = " || ".join([f"coalesce({other.format(v=f'v{k}', p='pos', k=k)}, '')" for k in range(low)] + [f"coalesce({other.format(v=f'u{k}', p='place', k=k)}, '')" for k in range(high)])
    crc = _CRC.format(b="list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)")
    return f"""WITH {_CRC_TABLE},
      d AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, {leaf("n_chars1")} AS claimed FROM (SELECT *, n_chars + CASE WHEN {crc} % 7 = 0 THEN 1 ELSE 0 END AS n_chars1 FROM documents, crc_table)),
      o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
      t AS (SELECT lang, list(leaf ORDER BY pos) AS v0 FROM o GROUP BY lang),
      {", ".join(levels(low, "t", "t"))},
      r AS (SELECT *, v{low}[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t{low}),
      w AS (SELECT list(subroot ORDER BY place) AS v0 FROM r),
      {", ".join(levels(high, "w", "w"))},
      p0 AS (SELECT o.*, r.* EXCLUDE (lang), {", ".join(f"w{high}.v{k} AS u{k}" for k in range(high + 1))}, claimed AS f0
        FROM o JOIN r ON o.lang IS NOT DISTINCT FROM r.lang, w{high}),
      {", ".join(folds)},
      q0 AS (SELECT *, f{low} AS g0 FROM p{low}),
      {", ".join(tops)}
      SELECT doc_id, leaf, subroot, u{high}[1] AS root, sha256({proof}) AS proof_sha256, g{high} AS folded_root, g{high} = u{high}[1] AS verified FROM q{high}"""


ORACLES: dict[str, str] = {
    "op11_jaccard_join": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      g AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
      n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
      p AS (SELECT x.r AS u, y.r AS v, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY ALL),
      l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 100 * c >= 90 * (a.n + b.n - c)),
      t AS (SELECT r AS u, r AS v FROM d UNION SELECT t.u, l.v FROM t JOIN l ON t.v = l.u)
      SELECT a.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b.doc_id) AS component_id
      FROM t JOIN d a ON a.r = t.u JOIN d b ON b.r = t.v LEFT JOIN n ON n.r = t.u GROUP BY t.u, a.doc_id""",
    "op12_merkle": _merkle_sql(),
    "op13_lexical": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
      i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
      l AS (SELECT r, count(*) AS n FROM d GROUP BY r),
      k AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM l),
      p AS (SELECT r, doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY ALL),
      w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, k GROUP BY t, nn),
      s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
        FROM i JOIN p USING (t) JOIN w USING (t) JOIN l USING (r), k GROUP BY item_id, r),
      o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank FROM s WHERE score > 0)
      SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op4_mixing": _mixing_sql(),
    "op5_line_dedup": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
      w AS (SELECT doc_id, p, ls[p] AS a, ls[p + 1] AS b, ls[p + 2] AS c FROM (SELECT *, unnest(range(1, len(ls) - 1)) AS p FROM l) WHERE trim(ls[p] || ls[p + 1] || ls[p + 2]) <> ''),
      r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS n FROM w),
      gone AS (SELECT DISTINCT doc_id, p + d AS p FROM r, (VALUES (0), (1), (2)) AS v(d) WHERE n > 1),
      one AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l)
      SELECT doc_id, count(*)::INTEGER AS n_lines, count(gone.p)::INTEGER AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY one.p) FILTER (gone.p IS NULL), '') AS kept_text
      FROM one LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id""",
    "op6_dart_minhash": r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      g0 AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
      g AS (SELECT r, s, row_number() OVER (PARTITION BY r, s) AS k FROM g0),
      n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
      p AS (SELECT x.r AS u, y.r AS v, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.k = y.k AND x.r <> y.r GROUP BY ALL),
      j AS MATERIALIZED (SELECT u, v, c, a.n AS nu, b.n AS nv FROM p JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE 10 * c >= 8 * (a.n + b.n - c)),
      t AS (SELECT r AS u, r AS v FROM d UNION SELECT t.u, j.v FROM t JOIN j ON t.v = j.u),
      e AS (SELECT u, min(doc_id) AS copy_of FROM (SELECT u, v FROM j WHERE c = nu AND c = nv UNION ALL SELECT r, r FROM d) JOIN d ON d.r = v GROUP BY u)
      SELECT a.doc_id, min(b.doc_id) AS class_id, any_value(copy_of) AS copy_of FROM t JOIN d a ON a.r = t.u JOIN d b ON b.r = t.v JOIN e ON e.u = t.u GROUP BY t.u, a.doc_id""",
    "op10_norm_search": """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
      SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
