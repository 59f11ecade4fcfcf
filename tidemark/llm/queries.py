"""The ``opN_`` queries: each operator over its whole standard table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, licences, lines, mixing, packing, quality, repair, restaurants, simhash, toxicity, vectors, wordpiece
from .common import table

TOXIC_AT = 0.3


def vocabulary_path() -> str:
    """The public vocabulary file, which the installed package names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def domain_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled rows: language and quality label."""
    level = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    own = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.select("doc_id", "lang").join(own, "doc_id").select("doc_id", F.concat_ws("-", "lang", level).alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, domain_labels(docs, table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "n_tokens", "rate", "copies", "target_gap", "domain", *[f"p{k}" for k in range(len(mixing.TARGETS))])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_hosts(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    made = chat.format_chats(rows.unionByName(probe))
    turns, loss = chat.read_turns(F.col("formatted")), chat.loss_texts(F.col("formatted"), F.col("loss_runs"))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = made.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    read = read.select("conv_id", "formatted", "turns", F.array_join(told, "").alias("told"), "loss")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("told", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(), digest_only=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()).select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        "n_offending", "worst_start", "worst_length", "worst_sentence",
    )


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restaurants.score_documents(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damage(table(spark, sf_dir, "conversations"))
    told = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return repair.repair(rows, present=F.col("present")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(told, "\n"), 256).alias("repaired_sha256")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_quality_rules, op3_line_dedup, op4_chat_format, op5_near_vectors,
        op6_token_counts, op7_licence_scan, op8_packing, op9_simhash, op10_toxicity,
        op11_lm_scores, op12_repair, op13_collocations,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op2_quality_rules": r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT doc_id, source, body, words, len(words) AS n,
    [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] AS wins
  FROM w),
rep AS (
  SELECT doc_id, count(DISTINCT w_at + o) AS n_repeat_words
  FROM (
    SELECT doc_id, w_at, count(*) OVER (PARTITION BY doc_id, win) AS c
    FROM (SELECT doc_id, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS w_at FROM g)), range(0, 5) t(o)
  WHERE c > 1 GROUP BY doc_id),
ls AS (
  SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
b AS (
  SELECT g.doc_id, source, g.n AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM g JOIN ls USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repetitive FROM b),
h AS (SELECT source, count(*) AS n, sum(short::INT) AS fs, sum(repetitive::INT) AS fr FROM f GROUP BY source),
m AS (
  SELECT sum(n) / count(*) AS avg_n, least(greatest(sum(fs) / sum(n), 1e-6), 1 - 1e-6) AS ms, var_pop(fs / n) AS vs,
    least(greatest(sum(fr) / sum(n), 1e-6), 1 - 1e-6) AS mr, var_pop(fr / n) AS vr FROM h),
s AS (
  SELECT ms, mr, least(greatest(CASE WHEN vs > 0 THEN ms * (1 - ms) / vs - 1 ELSE avg_n END, 1.0), greatest(avg_n, 1.0)) AS ks,
    least(greatest(CASE WHEN vr > 0 THEN mr * (1 - mr) / vr - 1 ELSE avg_n END, 1.0), greatest(avg_n, 1.0)) AS kr FROM m),
r AS (SELECT source, n, (fs + ms * ks) / (n + ks) AS hs, (fr + mr * kr) / (n + kr) AS hr, ms, mr, ks, kr FROM h, s),
v AS (
  SELECT source, hs - 2 * sqrt(hs * (1 - hs) / (n + ks + 1)) > least(3 * ms, 0.5)
    OR hr - 2 * sqrt(hr * (1 - hr) / (n + kr + 1)) > least(3 * mr, 0.5) AS bad FROM r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND NOT bad AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
""",
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
k AS (SELECT *, trim({_LOWER.format("line")}, {_BLANKS}) AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id
""",
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS starts, coalesce(lead(role) OVER w <> role, true) AS ends,
    replace(replace(replace(replace(text, '\', '\e'), '</turn>', '<\/turn>'), '</part>', '<\/part>'), '### ', '#\## ') AS body
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN starts THEN 6 + length(role) ELSE 7 END + length(body) + CASE WHEN ends THEN 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
""",
    "op12_repair": r"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS fate FROM d),
g AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, range(2) t(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM o),
r AS (
  SELECT conv_id, turn, pos, role, text, left(role, 1) AS said, final = '' AS blank, final <> '' AND again AS duplicate,
    final <> '' AND NOT again AND NOT regexp_matches(final, '[.!?]') AS truncated,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM p),
fig AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM r GROUP BY conv_id),
ins(q, fee, letters, lines, q2) AS (
  VALUES (0, 0, '', []::VARCHAR[], 0), (1, 0, '', [], 1), (2, 0, '', [], 2), (3, 0, '', [], 3), (0, 3, 'I', ['user:'], 2), (1, 3, 'I', ['user:'], 2),
    (2, 3, 'I', ['assistant:'], 3), (3, 3, 'I', ['user:'], 2), (0, 6, 'II', ['user:', 'assistant:'], 3), (1, 6, 'II', ['user:', 'assistant:'], 3),
    (2, 6, 'II', ['assistant:', 'user:'], 2), (3, 6, 'II', ['user:', 'assistant:'], 3)),
step(q2, made, q3) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ed AS (
  SELECT conv_id, pos, 'D' AS letter, 4 AS fee, NULL AS made, []::VARCHAR[] AS lines FROM r
  UNION ALL SELECT conv_id, pos, 'K', CASE WHEN truncated THEN 3 ELSE 0 END, said, [role || ':' || text] FROM r
  WHERE NOT blank AND NOT duplicate AND said IN ('s', 'u', 'a')
  UNION ALL SELECT conv_id, pos, 'R', CASE WHEN truncated THEN 6 ELSE 3 END, left(name, 1), [name || ':' || text]
  FROM r, (VALUES ('user'), ('assistant')) v(name) WHERE NOT blank AND NOT duplicate AND said <> left(name, 1)),
w AS (
  SELECT conv_id, 0::BIGINT AS pos, 0 AS q, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM fig
  UNION ALL
  SELECT conv_id, pos, q, min(best) AS best FROM (
    SELECT w.conv_id, ed.pos, coalesce(q3, ins.q2) AS q, {'cost': best.cost + ins.fee + ed.fee, 'audit': best.audit || ins.letters || letter,
      'lines': list_concat(list_concat(best.lines, ins.lines), ed.lines)} AS best
    FROM w JOIN ins ON w.q = ins.q JOIN ed ON ed.conv_id IS NOT DISTINCT FROM w.conv_id AND ed.pos = w.pos + 1
    LEFT JOIN step ON step.q2 = ins.q2 AND step.made = ed.made WHERE ed.made IS NULL OR q3 IS NOT NULL)
  GROUP BY conv_id, pos, q),
e AS (
  SELECT fig.conv_id, min({'cost': best.cost + fee, 'audit': best.audit || letters, 'lines': list_concat(best.lines, ins.lines)}) AS best
  FROM w JOIN fig ON fig.conv_id IS NOT DISTINCT FROM w.conv_id AND n = pos JOIN ins ON w.q = ins.q WHERE q2 IN (0, 3) GROUP BY fig.conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN fig ON i.conv_id IS NOT DISTINCT FROM fig.conv_id
LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
""",
    "op13_collocations": rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, len, unnest([array_to_string(ws[i:i + len - 1], ' ') FOR i IN range(1, len(ws) - len + 2)]) AS phrase FROM w, range(1, 6) t(len)),
c AS (SELECT lang, len, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE len = 1 GROUP BY lang),
k AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE len >= 2 AND f >= 100),
x AS (SELECT *, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail FROM k, range(1, 5) r(cut) WHERE cut < len),
s AS (
  SELECT x.lang, x.phrase, cut, a, h.f AS l, q.f AS r, n, (1000 * a * n) // (h.f * q.f) AS score
  FROM x JOIN c h ON x.lang = h.lang AND head = h.phrase JOIN c q ON x.lang = q.lang AND tail = q.phrase JOIN t ON x.lang = t.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, array_to_string(ws[o:o + size - 1], ' ') AS phrase, max(a) AS longer
  FROM k, range(2, 5) v(size), range(1, 5) u(o) WHERE size < len AND o + size - 1 <= len GROUP BY ALL),
z AS (
  SELECT b.* FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM z QUALIFY rank <= 2000
""",
}
