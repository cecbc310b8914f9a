"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import bpe, decontaminate, html_text, language_id, license_scan, near_dedup, packing, quality, toxicity, turns, url_filter, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=2, percent=80)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(spark, table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, table(spark, sf_dir, "documents")).withColumn("divergence", F.round("divergence", 6))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(spark, docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have all evidence: text between tags, declared markup language, suffix and host of the address. The model's bounded training sample is labelled by lang of documents."""
    model = language_id.fit(spark, table(spark, sf_dir, "documents"))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select("page_id", text.alias("text"), F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]{2})", 1).alias("declared"), F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("host"))
    return language_id.identify(spark, pages, model, "page_id", host_col="host", declared_col="declared")


def language_id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no markup and no address: text and source are the evidence, a source has no suffix, so its prior is smoothed by that of all rows. lang labels the bounded training sample, and is no evidence."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(spark, docs, language_id.fit(spark, docs), "doc_id", host_col="source")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"), default_tokenizer(), ("ids_sha256", "decoded_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = turns.repair(turns.damage(table(spark, sf_dir, "conversations")), "copies")
    return repaired.withColumn("repaired_sha256", turns.digest(F.col("repaired"))).drop("repaired")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(spark, table(spark, sf_dir, "documents"), word_tokenizer())
    return packing.pack(spark, pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(spark, table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(spark, coded).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_html_text, op3_quality, op4_toxicity, op5_near_dedup, op6_language_id, op7_bpe, op8_decontamination, op9_license, op10_url_filter, op11_turns, op12_packing, op13_vector_codes, language_id_documents)}
QUERIES["language_id_pages"] = op6_language_id  # its name before
_B32 = " || ".join(f"substr('{warc.BASE32}', cast((v[{i + 1}] >> {shift}) & 31 as int) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))



def _distance(p: str, q: list[float]) -> str:
    """SQL of the Jensen-Shannon distance of a list of shares (all null: no distance) and fixed shares."""
    shares = f"[{', '.join(repr(x / sum(q)) for x in q)}]"
    part = lambda x: f"case when {x} > 0 then {x} * log2({x} / ((s[1] + s[2]) / 2)) else 0 end"
    return f"case when list_sum({p}) > 0 then sqrt(greatest(list_sum(list_transform(list_zip({p}, {shares}), lambda s: {part('s[1]')} + {part('s[2]')})) / 2, 0)) end"


def _quality_sql() -> str:
    long, wide = quality.LEAST_WORDS, f"chars >= {quality.LEAST_CHARS}"
    near, other = [], []
    for shares, common, merged in quality.references():
        c, w = f"case when {wide} then {_distance('classes', shares)} end", f"case when n_words >= {long} then {_distance('common', common)} end"
        near.append(f"coalesce(({c} + {w}) / 2, {c}, {w}, 0)")
        other.append(f"coalesce(case when {wide} then {_distance('letters', merged)} end, 0)")
    following = ", ".join(f"lead(x, {i}) over o" for i in range(quality.WINDOW))
    names, langs = (f"[{', '.join(repr(x) for x in y)}]" for y in (quality.WORDS, sorted(quality.SHARES)))
    return rf"""with d as (select doc_id, lang, coalesce(text, '') as text from documents),
 w as (select doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
  list_transform(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: strlen(x) <= {max(map(len, quality.WORDS))}), lambda x: lower(x)) as short from d),
 u as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i, len(w) as n from w),
 i as (select doc_id, i, n, concat_ws(' ', {following}) as g from u window o as (partition by doc_id order by i)),
 r as (select doc_id, i, count(*) over (partition by doc_id, g) as n from i where i <= n - {quality.WINDOW - 1}),
 v as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + {quality.WINDOW})) as p from r where n > 1) group by doc_id),
 m as (select doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, length(text) as chars, strlen(text) as bytes, len(regexp_extract_all(text, '[0-9]')) as digit, len(regexp_extract_all(text, '[A-Z]')) as upper,
  len(regexp_extract_all(text, '[.,;:!?''"()-]')) as stop, list_transform({names}, lambda k: len(list_filter(short, lambda x: x = k))) as each from w left join v using (doc_id)),
 c as (select *, chars - word_chars as space, least(bytes - chars, chars) as wide, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, list_append(each, n_words - list_sum(each)) as common from m),
 o as (select *, greatest(chars - space - digit - upper - stop - n_symbols - wide, 0) as other from c),
 l as materialized (select *, [space, digit, upper, stop, n_symbols, wide, other] as c0, [space, digit, stop, n_symbols, upper + wide + other] as l0 from o),
 s as materialized (select *, list_sum(c0) as nc, list_sum(common) as nw from l),
 h as materialized (select * exclude (common), list_transform(c0, lambda x: x / nc) as classes, list_transform(l0, lambda x: x / nc) as letters, list_transform(common, lambda x: x / nw) as common from s),
 f as (select *, case when base_failed then null when list_contains({langs}, lang) then least({', '.join(near)}) else least({', '.join(other)}) end as far from h)
 select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
 cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and coalesce(far, 0) <= {quality.FAR} as kept, round(far, 6) as divergence from f"""


def _turns_sql() -> str:
    """Paths are strings: nine digits of cost, then the audit, with I, J and R, S for user and assistant; so least() keeps the better. A recursion goes over the turns."""
    never = "'500000000'"
    path = lambda p, cost, letter: f"lpad(cast(cast(substr({p}, 1, 9) as bigint) + {cost} as varchar), 9, '0') || substr({p}, 10) || '{letter}'"
    return rf"""with recursive crc as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select range as i from range(256)))),
 r as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
 k as (select r.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as k from r, crc),
 d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) as copy from k where k <> 0),
 o as (select *, substr(role, 1, 1) as initial, row_number() over w as i, lag(substr(role, 1, 1)) over w as before, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from d window w as (partition by conv_id order by turn nulls first, role, text, copy)),
 b as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, nth > 1 and regexp_matches(text, '[^\x20\x09-\x0D]') as duplicate from o),
 f as materialized (select *, not blank and not duplicate and not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as truncated, before is not null and before || initial not in ('su', 'ua', 'au') as illegal from b),
 s(conv_id, i, n, s, u, a) as (select distinct conv_id, cast(0 as bigint), '000000000', {never}, '000000003I', '000000006IJ' from conversations
  union all select conv_id, i, n, s, u, least(a, {path("u", 3, "J")}) from (select conv_id, i, n, s, least(u, {path("least(n, s, a)", 3, "I")}) as u, a from (
   select x.conv_id, x.i + 1 as i, {path("n", 4, "D")} as n, least({path("s", 4, "D")}, case when lives and initial = 's' then {path("n", "cut", "K")} else {never} end) as s,
    least({path("u", 4, "D")}, case when lives and initial = 'u' then {path("least(n, s, a)", "cut", "K")} else {never} end, case when lives then {path("least(n, s, a)", "cut + 3", "R")} else {never} end) as u,
    least({path("a", 4, "D")}, case when lives and initial = 'a' then {path("u", "cut", "K")} else {never} end, case when lives then {path("u", "cut + 3", "S")} else {never} end) as a
   from s x join (select conv_id, i, initial, not blank and not duplicate as lives, case when truncated then 3 else 0 end as cut from f) t on t.conv_id is not distinct from x.conv_id and t.i = x.i + 1))),
 e as (select conv_id, substr(best, 10) as audit, cast(substr(best, 1, 9) as bigint) as cost from (select conv_id, least(n, a) as best, row_number() over (partition by conv_id order by i desc) as last from s) where last = 1),
 l as (select conv_id, unnest(string_split(audit, '')) as c, unnest(range(1, length(audit) + 1)) as p from e where audit <> ''),
 m as (select *, sum(case when c in ('I', 'J') then 0 else 1 end) over (partition by conv_id order by p) as i from l),
 z as (select m.conv_id, string_agg(case c when 'I' then 'user:' when 'J' then 'assistant:' when 'K' then role || ':' || text when 'R' then 'user:' || text else 'assistant:' || text end, chr(10) order by p) as whole
  from m left join f on f.conv_id is not distinct from m.conv_id and f.i = m.i where c <> 'D' group by m.conv_id),
 g as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated, count(*) filter (where illegal) as illegal from f group by conv_id)
 select e.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, translate(audit, 'JS', 'IR') as audit, sha256(coalesce(whole, '')) as repaired_sha256
 from e left join g on g.conv_id is not distinct from e.conv_id left join z on z.conv_id is not distinct from e.conv_id"""


def _codes_sql() -> str:
    """A table for each round's codebooks; distances over all pairs of a part and an entry of its position."""
    v = vector_codes
    nearest = lambda c: f"(select row, pos, part, arg_min(entry, d) as entry, min(d[1]) as far from (select row, p.pos, p.part, entry, [list_sum(list_transform(list_zip(p.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry] as d from p join {c} c using (pos)) group by row, pos, part)"
    rounds = "".join(
        f""" c{i + 1} as materialized (select c.pos, c.entry, coalesce(n.part, c.part) as part from c{i} c left join (select pos, entry, list(v order by j) as part from (select pos, entry, j, cast(floor(sum(x) / count(*)) as bigint) as v
  from (select pos, entry, unnest(part) as x, unnest(range(len(part))) as j from {nearest(f"c{i}")}) group by pos, entry, j) group by pos, entry) n using (pos, entry)),"""
        for i in range(v.ROUNDS)
    )
    return f"""with k as materialized (select row_number() over (order by vec_id, ints) - 1 as row, vec_id, label, ints from (select vec_id, label, list_transform(embedding, lambda x: cast(floor({v.SCALE} * cast(x as double)) as bigint)) as ints
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
 p as materialized (select row, pos, ints[pos * len(ints) // {v.PARTS} + 1:(pos + 1) * len(ints) // {v.PARTS}] as part from k, (select range as pos from range({v.PARTS}))),
 c0 as materialized (select pos, row as entry, part from p where row < {v.ENTRIES}),{rounds}
 e as (select row, string_agg(lower(lpad(hex(entry), 2, '0')), '' order by pos) as code, cast(sum(far) as bigint) as error from {nearest(f"c{v.ROUNDS}")} group by row),
 h as (select sha256(string_agg(x, ',' order by pos, entry, j)) as codebooks_sha256 from (select pos, entry, unnest(list_transform(part, lambda y: cast(y as varchar))) as x, unnest(range(len(part))) as j from c{v.ROUNDS}))
 select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from k join e using (row), h"""


ORACLE_SQL: dict[str, str] = {
    "op3_quality": _quality_sql(),
    "op11_turns": _turns_sql(),
    "op13_vector_codes": _codes_sql(),
    "op1_warc": f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d from pages),
 x as (select page_id, html, max(page_id) over (partition by html) as top, list_transform(range(8), lambda i: cast('0x' || substr(d, 5 * i + 1, 5) as bigint)) as v from p)
 select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {_B32} as payload_digest,
 case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id = top then null else top end as refers_to from x""",
    "op5_near_dedup": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else cast([] as varchar[]) end as s from w),
 n as (select doc_id, len(s) as n, s from s), e as (select doc_id, n, unnest(s) as x from n),
 l as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 g as (select a, b from l union all select b, a from l),
 r(v, m) as (select doc_id, doc_id from n union select g.b, r.m from r join g on r.v = g.a where r.m < g.b)
 select doc_id, cast(n as bigint) as n_shingles, c as component_id, c = doc_id as kept from n join (select v, min(m) as c from r group by v) on v = doc_id""",
}
