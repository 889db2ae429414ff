"""One query for each operator, over the whole of its table, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embedding, langid, license_scan, minhash, mixing, pii, secrets, substring, toxicity
from ._store import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < sum(k.base for k in pii.KINDS))
    counts = [of(i).alias(f"n_{k.name}") for i, k in enumerate(pii.KINDS) if k.base]
    score = F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"), score.alias("score"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(read(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(read(spark, sf_dir, "documents"), width=4, percent=80)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    best = F.coalesce(F.array_max(F.transform("items", lambda x: x["similarity"])), F.lit(0.0))
    n = F.size("items").cast("long")
    return found.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.transform("items", lambda x: x["item"]).alias("item_ids"), best.alias("similarity"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < sum(k[5] for k in secrets.KINDS))
    counts = [of(i).alias(f"n_{k[0]}") for i, k in enumerate(secrets.KINDS) if k[5]]
    live = F.size(F.filter("found", lambda s: s["live"])).cast("long")
    owners = F.coalesce(F.array_max(F.transform("found", lambda s: s["owners"])), F.lit(0))
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"), live.alias("n_live"), owners.cast("long").alias("most_owners"))


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.link_embeddings(read(spark, sf_dir, "embeddings"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_pii that SQL can say."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_licenses that SQL can say."""
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_secrets that SQL can say."""
    return op9_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {"op1_pii": op1_pii, "op2_licenses": op2_licenses, "op3_toxicity": op3_toxicity, "op4_mixing": op4_mixing, "op5_language": op5_language, "op6_minhash": op6_minhash, "op7_substring": op7_substring, "op8_decontamination": op8_decontamination, "op9_secrets": op9_secrets, "op10_embedding": op10_embedding}
#: Parts of op1, op2 and op9, beside SQL for them.
QUERIES |= {"pii_base": pii_base, "license_base": license_base, "secret_base": secret_base}

#: kind, pattern, what a match x has to be. Starts are the lengths of the pieces up to a match and of the matches before it.
_PII_RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: cast(p as hugeint) > 255)) = 0"),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        """len(regexp_replace(x, '[^0-9]', '', 'g')) between 14 and 19 and list_sum(list_transform(range(1, len(regexp_replace(x, '[^0-9]', '', 'g')) + 1), lambda i:
          case when i % 2 = 1 then cast(reverse(regexp_replace(x, '[^0-9]', '', 'g'))[i] as int)
          else cast(reverse(regexp_replace(x, '[^0-9]', '', 'g'))[i] as int) * 2 - case when cast(reverse(regexp_replace(x, '[^0-9]', '', 'g'))[i] as int) > 4 then 9 else 0 end end)) % 10 = 0""",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace(x, '[^0-9]', '', 'g')) between 10 and 15"),
)
_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_SECRET_RULES = (
    ("assign", _ASSIGN, r"""len(regexp_extract(x, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 12"""),
    ("access", "AKIA[A-Z0-9]+", "len(x) >= 18"),
    ("hex", "[0-9a-f]+", "len(x) >= 16"),
)


def _span_sql(rules: tuple[tuple[str, str, str], ...]) -> str:
    each = [
        f"""select doc_id, {k} as k, '{name}' as kind, gaps, found, unnest(range(1, len(found) + 1)) as i
          from (select doc_id, regexp_split_to_array(t, '{pattern}') as gaps, regexp_extract_all(t, '{pattern}') as found from docs)"""
        for k, (name, pattern, _) in enumerate(rules)
    ]
    good = " ".join(f"when '{name}' then {check}" for name, _, check in rules)
    counts = ", ".join(f"count(*) filter (kind = '{name}') as n_{name}" for name, _, _ in rules)
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
matched as ({" union all ".join(each).replace("doc_id,", "r,").replace("from (select doc_id", "from (select r")}),
placed as (
  select r, k, kind, found[i] as x, cast(list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: len(m))), 0) as bigint) as start
  from matched
), valid as (select * from placed where case kind {good} end),
spans as (select r, {counts}, string_agg(kind || ':' || start || ':' || (start + len(x)), ',' order by start, k) as listed from valid group by r)
select doc_id, {", ".join(f"coalesce(n_{name}, 0) as n_{name}" for name, _, _ in rules)}, sha256(coalesce(listed, '')) as base_sha256
from docs left join spans using (r)
"""


#: Words, and the places of the fixed phrases among them.
LICENSE_BASE_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), phrases as (select * from (values (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) t(p, label)),
places as (select r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(p)] = p)) as place from docs, phrases),
found as (select r, count(*) as n, min(place) as first, max(place) as last, array_to_string(list_sort(list(distinct label)), ',') as labels from places group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, first as first_word, last as last_word, coalesce(labels, '') as base_labels
from docs left join found using (r)
"""

#: All pairs within a label, their links as counts and as components; the rest of op10's contract is arithmetic.
OP10_SQL = """
with recursive flat as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
), sound as (
  select vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from flat
  where label is not null and v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) >= 0.98
), reach(id, node) as (
  select vec_id, vec_id from embeddings union select reach.id, links.b from reach join links on reach.node = links.a
), least as (select id, min(node) as component_id from reach group by id),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(c.n, 0) as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join least l on l.id = e.vec_id left join counts c on c.a = e.vec_id
"""

#: All pairs that share a shingle, by their counts; components by reaching.
OP6_SQL = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), starts as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as s from docs where len(w) > 0),
shingle as (select distinct doc_id, array_to_string(w[s:s + 3], ' ') as x from starts),
size as (select doc_id, count(*) as n from shingle group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingle a join shingle b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
sides as (select a, b from links union all select b, a from links),
reach(id, node) as (select doc_id, doc_id from docs union select reach.id, sides.b from reach join sides on reach.node = sides.a),
least as (select id, min(node) as component_id from reach group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from docs d join least l on l.id = d.doc_id left join size using (doc_id)
"""

#: Targets of the sources, rates of the sizes' classes, whole copies, then documents in the Pareto order as long as half of the
#: document fits the source's rest.
OP4_SQL = r"""
with docs as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    cast('0x' || substr(md5('17|' || coalesce(cast(doc_id as varchar), md5(text), '')), 1, 13) as bigint) as hash from documents
), sources as (select source, cast(sum(size) as bigint) as source_size from docs group by source),
weighed as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight, source_size * 3.0::double as cap from sources),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level,
    row_number() over (order by cap / weight, source nulls last) as nth from weighed
  window o as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)
), water as (select level from levels where level * weight <= cap order by nth limit 1),
goals as (select source, source_size, least(cap, coalesce((select level from water), 0) * weight) as target from levels),
sized as (select *, length(bin(size)) - 1 as bits from docs where size > 0),
classes as (
  select c.source, bits, words, bits + 4.0::double as weight, (bits + 4.0::double) * words as load, target
  from (select source, bits, cast(sum(size) as bigint) as words from sized group by 1, 2) c join goals g on g.source is not distinct from c.source
), lifted as (
  select *, (target - 3.0::double * coalesce(sum(words) over a, 0)) / (sum(load) over (partition by source) - coalesce(sum(load) over a, 0)) as level
  from classes window a as (partition by source order by bits desc rows between unbounded preceding and 1 preceding)
), found as (select source, max_by(level, bits) as level from lifted where level * weight <= 3.0::double group by source),
rates as (
  select l.source, bits, words, target, coalesce(least(3.0::double, f.level * weight), 3.0::double) as rate
  from lifted l left join found f on f.source is not distinct from l.source
), shares as (select *, cast(floor(rate + 1e-9) as bigint) as whole, greatest(rate - floor(rate + 1e-9), 0.0::double) as p from rates),
opened as (select source, first(target) - sum(whole * words) as open from shares group by source),
odds as (
  select d.doc_id, d.source, d.size, s.whole, s.p, o.open, ((hash + 0.5::double) / 4503599627370496) as u
  from sized d join shares s on s.source is not distinct from d.source and s.bits = d.bits join opened o on o.source is not distinct from d.source
), pareto as (select *, (u / (1 - u)) / (p / (1 - p)) as q from odds where p > 0),
ranked as (
  select *, coalesce(sum(size) over (partition by source order by floor(least(q / (1 + q), 1 - power(2.0::double, -53)) * 9007199254740992), doc_id, size
    rows between unbounded preceding and 1 preceding), 0) as before from pareto
), copied as (
  select doc_id, source, size, whole + case when open > 0 and open - before > 0 and open - before >= size / 2 then 1 else 0 end as copies from ranked
  union all select doc_id, source, size, whole from odds where p = 0
  union all select doc_id, source, size, 0 from docs where size = 0
)
select c.doc_id, c.size, g.source_size, round(g.target, 6) as target, c.size * copies as taken, copies
from copied c join goals g on g.source is not distinct from c.source
"""

#: Every window of 20 words by its words; those with an earlier place take their words away.
OP7_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as s from docs where len(w) >= 20),
windows as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as words from starts),
later as (select doc_id, s from windows qualify row_number() over (partition by words order by doc_id, s) > 1),
covered as (select distinct doc_id, unnest(range(s, s + 20)) as i from later),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from docs),
kept as (select word.doc_id, count(*) as n, string_agg(x, ' ' order by i) as text from word anti join covered using (doc_id, i) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join kept k using (doc_id)
"""

ORACLES: dict[str, str] = {"op4_mixing": OP4_SQL, "op6_minhash": OP6_SQL, "op7_substring": OP7_SQL, "op10_embedding": OP10_SQL, "pii_base": _span_sql(_PII_RULES), "license_base": LICENSE_BASE_SQL, "secret_base": _span_sql(_SECRET_RULES)}
