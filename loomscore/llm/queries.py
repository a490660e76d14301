"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, cotraining, fim, license_rules, mixing, mpeg, partenum, pii, quality_rules, scratch, simhash, token_files, url_cascade

def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest rule's, else by a list of keys (host and path).

    The list: keys that were crawled with a campaign parameter in their url.
    """
    pages = url_cascade.with_host_path(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("key", F.concat("host", "path"))
    listed = pages.filter(F.contains("url", F.lit("utm_source="))).select("key")
    cascade, shards = url_cascade.build(pages.select("key"), listed)
    found = url_cascade.judge(pages, "key", cascade, shards)
    rule, verdict = url_cascade.rule_columns(RULES)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")


OP1_SQL = """
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
listed AS (SELECT DISTINCT host || path AS key FROM parts WHERE contains(url, 'utm_source=')),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, key IS NOT NULL AS listed
FROM parts LEFT JOIN fit USING (page_id) LEFT JOIN listed ON key = host || path
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.components(docs).select("doc_id", "fingerprint", "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to files and read back from them."""
    path = scratch.folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path).select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document names."""
    return license_rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of sources: every copy of every document with its place in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mix = mixing.fit(docs)
    return mixing.realised(mixing.apply(docs.select("doc_id", "source"), mix), mix)


OP5_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, '(none)') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS n FROM documents),
totals AS (SELECT s, CAST(sum(n) AS BIGINT) AS t FROM docs GROUP BY s),
p AS (SELECT t / sum(t) OVER () AS p, t FROM totals WHERE t > 0),
facts AS (SELECT max(p) / min(p) AS spread, -sum(p * ln(p)) AS h, ln(count(*)) AS most, max(t) AS top, sum(t) AS total FROM p),
bisect(i, elow, ehigh, rlow, rhigh) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1,
    CASE WHEN e THEN (elow + ehigh) / 2 ELSE elow END, CASE WHEN e THEN ehigh ELSE (elow + ehigh) / 2 END,
    CASE WHEN r THEN (rlow + rhigh) / 2 ELSE rlow END, CASE WHEN r THEN rhigh ELSE (rlow + rhigh) / 2 END
  FROM (
    SELECT b.*, pow(spread, 1 - (rlow + rhigh) / 2) > 2.0 AS r,
      (SELECT ln(sum(pow(p, (elow + ehigh) / 2))) - (elow + ehigh) / 2 * sum(pow(p, (elow + ehigh) / 2) * ln(p)) / sum(pow(p, (elow + ehigh) / 2)) FROM p) >= 0.95 * most AS e
    FROM bisect b, facts WHERE i < 40)),
found AS (SELECT greatest(CASE WHEN h >= 0.95 * most THEN 1 ELSE elow END, CASE WHEN spread <= 2.0 THEN 0 ELSE rhigh END) AS x, top, total FROM bisect, facts WHERE i = 40),
norm AS (SELECT x, top, total, (SELECT sum(pow(p, x)) FROM p) AS z FROM found),
weighed AS (
  SELECT s, t, CASE WHEN t > 0 THEN round(pow(t / total, x) / z, 9) ELSE 0 END AS weight, ceil(top / round(pow(top / total, x) / z, 9)) AS budget FROM totals, norm),
quotas AS (SELECT s, t, weight, CASE WHEN t > 0 THEN greatest(CAST(floor(weight * budget) AS BIGINT), t) ELSE 0 END AS quota FROM weighed),
sources AS (
  SELECT s, t, weight, quota, CASE WHEN t > 0 THEN quota // t ELSE 1 END AS passes,
    CAST(greatest(1, ceil(t / 65536)) AS BIGINT) AS blocks FROM quotas),
placed AS (
  SELECT d.doc_id, d.source, d.s, d.n, passes, weight, quota - passes * t AS rest,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % blocks AS block
  FROM docs d JOIN sources USING (s)),
per_block AS (SELECT s, block, sum(n) AS n, any_value(passes) AS passes, any_value(rest) AS rest FROM placed GROUP BY s, block),
per_pass AS (SELECT *, unnest(range(1, passes + CASE WHEN rest > 0 THEN 2 ELSE 1 END)) AS pass FROM per_block),
ranked AS (
  SELECT *, row_number() OVER o AS block_rank, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) - n AS before
  FROM per_pass WINDOW o AS (PARTITION BY s, pass ORDER BY md5('mix|' || pass || '|' || s || '|' || block), block)),
blocks AS (SELECT *, pass > passes AND before + n > rest AS at_end FROM ranked WHERE pass <= passes OR before < rest),
cut AS (SELECT p.s, p.doc_id, sum(p.n) AS n, any_value(b.passes) AS passes, any_value(b.rest - b.before) AS rest FROM placed p JOIN blocks b ON p.s = b.s AND p.block = b.block AND b.at_end GROUP BY ALL),
ends AS (
  SELECT s, doc_id, sum(n) OVER (PARTITION BY s ORDER BY md5('mix|' || (passes + 1) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS UNBOUNDED PRECEDING) - n < rest AS ends_in FROM cut),
copies AS (
  SELECT p.doc_id, p.source, p.s, p.weight, p.block, b.pass, b.block_rank
  FROM placed p JOIN blocks b ON p.s = b.s AND p.block = b.block LEFT JOIN ends e ON e.s = p.s AND e.doc_id IS NOT DISTINCT FROM p.doc_id WHERE NOT b.at_end OR e.ends_in)
SELECT doc_id, source, weight, block, CAST(pass AS INTEGER) AS pass, block_rank,
  dense_rank() OVER (PARTITION BY s, pass, block ORDER BY md5('mix|' || pass || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS place
FROM copies
"""


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by co-trained views of its content and its metadata."""
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    return cotraining.score(docs, model).select("doc_id", *(F.round(c, 6).alias(c) for c in cotraining.SCORES), "kept")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data and secrets."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and its likelihood ratio between trusted and raw text."""
    labels = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), labels.select("doc_id"))
    return judged.withColumn("score", F.round("score", 6))


def op10_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an MPEG audio stream, and what is read back from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mpeg.digest(mpeg.parsed(mpeg.stored(docs)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every document."""
    path = tokenizer("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digest(bpe.round_trip(docs, path, drop_text=True))


def bpe_digest(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the damage that a crc32 of conversation and turn picks for each."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("damage")).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage."""
    turns = table(spark, sf_dir, "conversations")
    rows = damaged(turns)
    found = scratch.written(conversation_repair.faults(rows))
    audited = scratch.written(conversation_repair.audits(found))
    digests = conversation_repair.digests(conversation_repair.repaired(rows, audited))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    parts = turns.select("conv_id").unionByName(conversation_repair.summary(found), True).unionByName(audited, True).unionByName(digests.withColumnRenamed("sha256", "repaired_sha256"), True)
    whole = parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers), *(F.max(c).alias(c) for c in ("audit", "repaired_sha256")))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


OP11_SQL = """
WITH RECURSIVE crc(t) AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(str_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS damage
  FROM conversations, crc),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(CASE WHEN damage = 3 THEN 2 ELSE 1 END) WHERE damage <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS n
  FROM rows_),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS wrong
  FROM placed),
counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) AS n_rows,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal
  FROM marked GROUP BY conv_id),
inserts(pre, here, goes, price) AS (VALUES
  ('', 'none', 'none', 0), ('', 's', 's', 0), ('', 'u', 'u', 0), ('', 'a', 'a', 0), ('I', 'none', 'u', 3), ('I', 's', 'u', 3), ('I', 'u', 'a', 3), ('I', 'a', 'u', 3),
  ('II', 'none', 'a', 6), ('II', 's', 'a', 6), ('II', 'u', 'u', 6), ('II', 'a', 'a', 6)),
reroles(here, goes) AS (VALUES ('none', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
best(conv_id, n, state, cost, audit, lines) AS (
  SELECT conv_id, 0::BIGINT, 'none', 0::BIGINT, '', []::VARCHAR[] FROM counts
  UNION ALL
  SELECT conv_id, n + 1, state, min(c), arg_min(a, (c, a)), arg_min(l, (c, a)) FROM (
    SELECT b.conv_id, b.n, e.state, b.cost + i.price + e.price + CASE WHEN m.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END AS c, b.audit || i.pre || e.edit AS a,
      b.lines || CASE i.pre WHEN '' THEN [] WHEN 'I' THEN [CASE i.goes WHEN 'a' THEN 'assistant:' ELSE 'user:' END] ELSE CASE i.goes WHEN 'a' THEN ['user:', 'assistant:'] ELSE ['assistant:', 'user:'] END END
        || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [m.role || ':' || m.text] ELSE [CASE e.state WHEN 'a' THEN 'assistant' ELSE 'user' END || ':' || m.text] END AS l
    FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.n = b.n JOIN inserts i ON i.here = b.state
    JOIN LATERAL (
      SELECT 'D' AS edit, i.goes AS state, 4 AS price
      UNION ALL SELECT 'K', m.initial, 0 WHERE m.fault NOT IN ('blank', 'duplicate') AND ((m.initial = 's' AND i.goes = 'none') OR (m.initial = 'u' AND i.goes IN ('none', 's', 'a')) OR (m.initial = 'a' AND i.goes = 'u'))
      UNION ALL SELECT 'R', r.goes, 3 FROM reroles r WHERE r.here = i.goes AND m.fault NOT IN ('blank', 'duplicate')) e ON true)
  GROUP BY conv_id, n, state),
ended AS (
  SELECT b.conv_id, b.cost + i.price AS cost, b.audit || i.pre AS audit, b.lines || CASE i.pre WHEN '' THEN [] WHEN 'I' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END AS lines
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.n = c.n_rows JOIN inserts i ON i.here = b.state AND i.goes IN ('none', 'a')),
least AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(lines, (cost, audit)) AS lines FROM ended GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN least l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard links of its shingles."""
    return partenum.components(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sides AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(x, y) AS (SELECT x, y FROM sides UNION SELECT r.x, b.y FROM reach r JOIN sides b ON b.x = r.y)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for fill-in-middle, and restored."""
    rows = fim.arranged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(fim.restored().cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
d AS (
  SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS h4 FROM h),
f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


QUERIES = {f.__name__: f for f in (op1_url_cascade, op2_simhash, op3_token_files, op4_license_rules, op5_mixing, op6_cotraining, op7_bpe, op8_pii, op9_quality_rules, op10_mpeg, op11_conversation_repair, op12_ngram_join, op13_fim)}
SQL: dict[str, str] = {"op1_url_cascade": OP1_SQL, "op5_mixing": OP5_SQL, "op4_license_rules": license_rules.scan_sql(), "op11_conversation_repair": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_fim": OP13_SQL}
