"""The registered queries of the text operators and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

import public_tokenizers

from . import angular, exact_dedup, language, licenses, linededup, minhash, mixing, packing, pii, quality, repair, substring, tokenfiles
from .common import documents


def _license_sql() -> str:
    """Phrases by their places in the list of words, templates by regular expressions over the words."""
    phrases = [(p.split(), label) for p, label in licenses.PHRASES.items()]
    places = ", ".join("list_filter(range(len(w)), lambda i: " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p, 1)) + ")" for p, _ in phrases)
    base = ", ".join(f"case when len(p[{n}]) > 0 then '{label}' end" for n, (_, label) in enumerate(phrases, 1))
    method = ", ".join("case when " + " or ".join(f"regexp_matches(t, ' {licenses.pattern(m)}')" for m in of) + f" then '{label}' end" for label, of in licenses.TEMPLATES.items())
    return rf"""
        with d as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
            from documents),
        p as (select doc_id, len(w) n, ' ' || array_to_string(w, ' ') || ' ' t, [{places}] p from d),
        f as (select doc_id, n, flatten(p) f, list_filter([{base}], lambda x: x is not null) b, list_filter([{method}], lambda x: x is not null) m from p)
        select doc_id, n n_words, len(f) n_base, list_min(f) first_word, list_max(f) last_word, array_to_string(list_sort(b), ',') base_labels, array_to_string(list_sort(list_distinct(b || m)), ',') labels,
            case when len(m) > 0 then 1.0 when len(f) > 0 then 0.5 else 0.0 end::double score from f
    """


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {
    "op1_line_dedup": lambda spark, d: linededup.line_report(documents(spark, d)),
    "op2_pii": lambda spark, d: pii.span_report(documents(spark, d)),
    "op3_exact_dedup": lambda spark, d: exact_dedup.exact_groups(documents(spark, d)),
    "op4_substring": lambda spark, d: substring.repeat_report(documents(spark, d)),
    "op5_language": lambda spark, d: language.language_report(documents(spark, d)),
    "op6_packing": lambda spark, d: packing.pack_ids(documents(spark, d), TOKENIZER),
    "op7_token_files": lambda spark, d: tokenfiles.token_report(documents(spark, d), TOKENIZER),
    "op8_near_dedup": lambda spark, d: minhash.near_groups(documents(spark, d), minhash.QUERY_THRESHOLD),
    "op9_mixing": lambda spark, d: mixing.mix_report(documents(spark, d)),
    "op10_quality": lambda spark, d: quality.quality_report(documents(spark, d)),
    "op11_hard_negatives": lambda spark, d: angular.mined(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op12_licenses": lambda spark, d: licenses.license_report(documents(spark, d)),
    "op13_repair": lambda spark, d: repair.repair_report(spark.read.parquet(f"{d}/conversations.parquet")),
}

ORACLE_SQL = {
    "op1_line_dedup": r"""
        with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) x from documents),
        l as (select doc_id, unnest(x) x, generate_subscripts(x, 1) - 1 i from t),
        s as (select doc_id, i, regexp_replace(x, '^[\x20\x09\x0B-\x0D]+|[\x20\x09\x0B-\x0D]+$', '', 'g') x from l where regexp_matches(x, '[^\x20\x09\x0B-\x0D]')),
        w as (select doc_id, i a, lead(i, 2) over p b, x || chr(10) || lead(x) over p || chr(10) || lead(x, 2) over p k from s window p as (partition by doc_id order by i)),
        v as (select doc_id, a, b, row_number() over (partition by k order by doc_id, a) r from w where b is not null),
        gone as (select distinct l.doc_id, l.i from l join v on l.doc_id = v.doc_id and l.i between v.a and v.b where r > 1)
        select l.doc_id, count(*) n_lines, count(gone.i) n_removed,
            sha256(coalesce(string_agg(case when gone.i is null then x end, chr(10) order by l.i), '')) kept_sha256
        from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id
    """,
    "op3_exact_dedup": r"""
        with n as (select doc_id, length(coalesce(text, '')) c, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) h from documents),
        g as (select h, first(doc_id order by c desc, doc_id) keep_id, count(*) group_size from n group by h)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from n join g using (h)
    """,
    "op4_substring": r"""
        with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        l as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from d),
        k as (select doc_id, i, x, string_agg(x, ' ') over p t, count(*) over p n from l window p as (partition by doc_id order by i rows between current row and 34 following)),
        r as (select doc_id, i, x, n = 35 and count(*) over (partition by t) > 1 again from k),
        c as (select doc_id, i, x, bool_or(again) over (partition by doc_id order by i rows between 34 preceding and current row) cut from r)
        select d.doc_id, count(x) n_words, count(*) filter (where cut) n_removed, sha256(coalesce(string_agg(x, ' ' order by i) filter (where not cut), '')) kept_sha256
        from d left join c on d.doc_id = c.doc_id group by d.doc_id
    """,
    "op8_near_dedup": r"""
        with recursive d as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
            from documents),
        l as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from d where len(w) >= 5),
        k as (select doc_id, x || ' ' || lead(x) over p || ' ' || lead(x, 2) over p || ' ' || lead(x, 3) over p || ' ' || lead(x, 4) over p g from l window p as (partition by doc_id order by i)),
        s as (select distinct doc_id, g from k where g is not null union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
        n as (select doc_id, count(*) n from s group by doc_id),
        p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
        m as (select d.doc_id, least(d.doc_id, min(b)) component_id from d left join r on d.doc_id = a group by d.doc_id)
        select m.doc_id, coalesce(n, 0) n_shingles, component_id, m.doc_id = component_id as kept from m left join n on m.doc_id = n.doc_id
    """,
    "op11_hard_negatives": r"""
        with r as (
            select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.v, b.v)::bigint s from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
        n as (select p.a, p.b p, p.s ps, s.b n, s.s ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) k from p join s on p.a = s.a where not same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
        select a anchor_id, p positive_id, k::int rank, n negative_id, ps positive_score, ns negative_score from n where k <= 3
    """,
    "op12_licenses": _license_sql(),
}
