"""Registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.llm import bpe, collocations, crosspolytope, fixity, hyperlang, licences, maintext, mixing, orderhash, personal, prefixtrie, simhash, tokenfiles
from reposift.llm.common import staged, table
from reposift.session import work_path


def op1_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    found = orderhash.edited_fingerprints(table(spark, folder, "documents"), permutations=64, length=2)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        orderhash.as_text(F.col("slots")).alias("fingerprint"), orderhash.as_text(F.col("edited_slots")).alias("edited_fingerprint"),
        "near_edited", "near_next")


def op2_hyperdimensional_language(spark: SparkSession, folder: str) -> DataFrame:
    return hyperlang.identify_languages(table(spark, folder, "documents"), keep=["doc_id"], n=3, dim=1024)


def op3_crosspolytope_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, folder, "embeddings"), least=0.98, tables=4, hashes=2, probes=4)


def op4_bpe_encode_decode(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(bpe.encode_documents(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op5_warc_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as WARC files in two replicas; the rule below damages about one record in 140 of them."""
    page, url, html = F.col("page_id"), F.col("url"), F.col("html")
    damage = F.substring(F.md5(F.coalesce(page.cast("string"), F.lit(""))), 1, 2)
    harmed = F.when(damage == "00", F.concat(F.lit("~"), F.substring(F.coalesce(html, F.lit("")), F.lit(2), F.char_length(html)))).otherwise(html)
    both = table(spark, folder, "pages").select(
        fixity.warc_file(page, url).alias("file"), page.cast("long").alias("page_id"), "url", damage.alias("damage"),
        fixity.record_entry(fixity.warc_record(page, url, html)).alias("left"),
        fixity.record_entry(fixity.warc_record(page, url, harmed)).alias("right"))
    both = fixity.placed(both.withColumn("length", F.col("left.length")), ["page_id", "url", "left.sha256"])
    both = staged(both, "replicas")
    replica = lambda side, lost: both.where(F.col("damage") != lost).select("file", "offset", f"{side}.length", f"{side}.sha256")
    return fixity.audit(replica("left", "02"), replica("right", "01"))


def op6_fair_queue_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op7_simhash_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"), threshold=2, shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_license_similarity_join(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan_licences(table(spark, folder, "documents"), threshold=0.9)
    labels = F.array_join(F.array_sort(F.array_distinct(F.col("found.label"))), ",")
    score = F.coalesce(F.array_max("found.containment"), F.lit(0.0))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "tokens")
    tokenfiles.write_token_files(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, path=path)
    return tokenfiles.token_offsets(spark, path)


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find_personal_data(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in personal.BASE], F.sha2(personal.spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        personal.spans_text(F.col("spans")).alias("spans"))


def op11_crf_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return maintext.extract_main_text(table(spark, folder, "pages"), keep=("page_id", "url"))


def op12_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, folder, "conversations"))


def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), least=100, longest=5, top=2000)


QUERIES = {f.__name__: f for f in (
    op1_order_minhash, op2_hyperdimensional_language, op3_crosspolytope_near_vectors, op4_bpe_encode_decode,
    op5_warc_merkle_fixity, op6_fair_queue_mix, op7_simhash_near_copies, op8_license_similarity_join, op9_token_files,
    op10_personal_data, op11_crf_main_text, op12_conversation_prefix_trie, op13_phrase_collocations)}

SQL = {
    "op5_warc_merkle_fixity": r"""
        with pages_ as (
            select page_id, coalesce(url, '') as url, coalesce(html, '') as html,
                   substr(md5(coalesce(cast(page_id as varchar), '')), 1, 2) as damage
            from pages),
        parts as (
            select *, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:',
                             coalesce(cast(page_id as varchar), ''), '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10),
                             'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ') as head,
                   concat(chr(13), chr(10), chr(13), chr(10)) as gap,
                   case when damage = '00' then concat('~', substr(html, 2)) else html end as harmed
            from pages_),
        records as (
            select cast(floor(page_id / 1000) as bigint) as file, page_id, url, damage,
                   concat(head, strlen(html), gap, html, gap) as a, concat(head, strlen(harmed), gap, harmed, gap) as b
            from parts),
        hashed as (select file, page_id, url, damage, strlen(a) as n, strlen(b) as m, sha256(a) as a, sha256(b) as b from records),
        placed as (
            select *, coalesce(sum(n) over (partition by file order by page_id, url, a rows between unbounded preceding and 1 preceding), 0) as begun
            from hashed)
        select file, cast(begun as bigint) as "offset",
               case damage when '01' then 'missing' when '02' then 'extra' else 'changed' end as status,
               case when damage <> '02' then a end as left_sha256, case when damage <> '01' then b end as right_sha256,
               case when damage <> '02' then n end as left_length, case when damage <> '01' then m end as right_length
        from placed where damage in ('01', '02') or damage = '00' and a <> b""",
    "op6_fair_queue_mix": r"""
        with sizes as (
            select doc_id, coalesce(concat('0', source), '1') as src,
                   md5(concat('mix:', coalesce(cast(doc_id as varchar), ''))) as key,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
            from documents),
        totals as (
            select src, cast(sum(size) as bigint) as source_size,
                   cast([3, 1, 2][(row_number() over (order by src) - 1) % 3 + 1] as double) as weight
            from sizes group by src),
        limits as (select *, source_size * 2::double as lim, sum(source_size) over () * 1.5::double as budget from totals),
        levels as (
            select *, row_number() over (order by lim / weight, src) as place,
                   (budget - coalesce(sum(lim) over (order by lim / weight, src rows between unbounded preceding and 1 preceding), 0))
                   / sum(weight) over (order by lim / weight, src rows between current row and unbounded following) as level
            from limits),
        open as (select min(place) as place, arg_min(level, place) as level from levels where level * weight < lim),
        targets as (
            select src, source_size, case when o.place is null or l.place < o.place then lim else o.level * weight end as target
            from levels l cross join open o),
        queued as (
            select s.*, source_size, target,
                   sum(size) over (partition by s.src order by key, doc_id nulls first, size rows unbounded preceding) as upto
            from sizes s join targets t on s.src = t.src),
        copies as (
            select *, (upto + turn * source_size)::double / target as time from queued cross join range(2) r(turn) where size > 0),
        taken as (
            select doc_id, src, key, size, upto, sum(size) over (order by time, key, doc_id nulls first, size rows unbounded preceding)
                   <= (select sum(target) from targets) as inside
            from copies)
        select q.doc_id, q.size, q.source_size, q.target, cast(q.size * count(t.src) as bigint) as taken
        from queued q left join taken t on q.doc_id is not distinct from t.doc_id and q.src = t.src and q.size = t.size
             and q.upto = t.upto and t.inside
        group by q.doc_id, q.size, q.source_size, q.target, q.src, q.upto""",
    "op12_conversation_prefix_trie": r"""
        with turns as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (
                partition by conv_id order by turn nulls first,
                sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as pos
            from conversations where conv_id is not null),
        sizes as (
            select conv_id, conv_id - conv_id % 100 as base, count(*) as own,
                   xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ord(c)::bigint)),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                           lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 6 as h
            from turns group by conv_id),
        convs as (
            select s.conv_id, s.base, s.h, least(s.h, coalesce(b.own, 0)) as lead, least(s.h, coalesce(b.own, 0)) + greatest(s.own - s.h, 0) as total
            from sizes s left join sizes b on b.conv_id = s.base),
        rebuilt as (
            select c.conv_id, lead + pos - h as depth, role, text from convs c join turns t on t.conv_id = c.conv_id and pos > h
            union all select c.conv_id, pos, role, text from convs c join turns t on t.conv_id = c.base and pos <= lead),
        paths as (
            select conv_id, depth, list({'r': role, 't': text}) over (partition by conv_id order by depth) as key, length(text) as chars from rebuilt
            union all select conv_id, 0, [], 0 from convs),
        nodes as (
            select depth, key, min(p.conv_id) as conv_id, count(*) as n_convs, min(chars) as chars, list_slice(key, 1, depth - 1) as up,
                   sha256(coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (where total = depth), '')) as ends_sha256
            from paths p join convs c on c.conv_id = p.conv_id group by depth, key),
        kids as (
            select p.depth, p.key, p.conv_id, count(*) as n_children, min(c.depth) from nodes p
            join nodes c on c.depth = p.depth + 1 and c.up = p.key group by all),
        marked as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join
                   (select depth, key, sum(n_children) as n_children from kids group by all) k on k.depth = n.depth and k.key = n.key),
        below as (
            select v.depth, v.key, count(*) filter (where u.n_children = 0) as n_leaves, sum((u.n_convs - 1) * u.chars) as saved_tokens
            from marked v join marked u on u.depth >= v.depth and list_slice(u.key, 1, v.depth) = v.key group by all)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, cast(n.n_children as bigint) as n_children, n_leaves,
               cast(saved_tokens as bigint) as saved_tokens, n.ends_sha256
        from marked n join below b on b.depth = n.depth and b.key = n.key
        left join nodes p on p.depth = n.depth - 1 and p.key = n.up""",
    "op13_phrase_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[.,;:!?\x0A-\x0D]')) as piece
            from documents),
        cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces),
        places as (select lang, words, unnest(range(1, len(words) + 1)) as pos from cut where len(words) > 0),
        counts as (
            select lang, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') as phrase, count(*) as f
            from places, range(1, 6) lengths(size) where pos + size - 1 <= len(words) group by all),
        sizes as (select lang, cast(sum(f) as bigint) as n from counts where size = 1 group by 1),
        frequent as (select *, string_split(phrase, ' ') as words from counts where f >= 100),
        inside as (
            select distinct lang, f, array_to_string(list_slice(words, k + 1, k + size - 1), ' ') as phrase
            from frequent, range(2) sides(k) where size >= 3),
        open as (
            select * from frequent c where size >= 2
            and not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and i.f = c.f)),
        cuts as (
            select o.lang, o.phrase, o.f as a, k, l.f as l, r.f as r, n,
                   (cast(1000 as hugeint) * o.f * n) // (cast(l.f as hugeint) * r.f) as score
            from open o join range(1, 5) places(k) on k < o.size join sizes z on z.lang = o.lang
            join frequent l on l.lang = o.lang and l.phrase = array_to_string(list_slice(o.words, 1, k), ' ')
            join frequent r on r.lang = o.lang and r.phrase = array_to_string(list_slice(o.words, k + 1, o.size), ' ')),
        lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n,
               cast(score as bigint) as score
        from lowest qualify rank <= 2000""",
}
