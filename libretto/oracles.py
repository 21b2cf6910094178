"""DuckDB SQL for semantics that need more than one expression: similarity, the split of long paragraphs, cleaning."""

from __future__ import annotations

from libretto.functions import scores as S
from libretto.functions import text as T

#: Words of a text between white space.
WORDS = "len(list_filter(regexp_split_to_array(trim({0}, e' \\t\\r\\n'), '\\s+'), lambda w: w <> ''))"
BAD = T.BOILERPLATE_ANY.replace("'", "''")
BARE = T.BARE_HEADING


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings, of which the first has less than 126 characters: one bit per character."""
    full = f"((1::hugeint << length({a})) - 1)"
    places = f"list_sum(list_transform(range(length({a})), lambda i: case when substr({a}, cast(i + 1 as bigint), 1) = ch then 1::hugeint << cast(i as int) else 0::hugeint end))"
    masks = f"list_transform(string_split({b}, ''), lambda ch: {places})"
    step = f"((r + (r & m)) | (r - (r & m))) & {full}"
    return f"(case when length({a}) = 0 or length({b}) = 0 then 0 else length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda r, m: {step})) end)"


def ratio(a: str, b: str, least: float = 0) -> str:
    """Indel similarity; 0 where the lengths alone keep it below ``least``."""
    return f"""(case when length({a}) + length({b}) = 0 then 100e0 when 200 * least(length({a}), length({b})) < {least} * (length({a}) + length({b})) then 0e0
        else 200e0 * {lcs(a, b)} / (length({a}) + length({b})) end)"""


def heading_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def split_blobs(source: str, name: str) -> str:
    """CTEs that end in ``name`` (id, pos, grp, p): the paragraphs of ``source`` (id, pos, p), long ones cut into groups of sentences. Needs ``with recursive``."""
    sentences = f"list_filter(list_transform(string_split(regexp_replace(p, '([.!?…][\"'']?)\\s+', e'\\\\1\\x01', 'g'), chr(1)), lambda x: trim(x, e' \\t\\r\\n')), lambda x: x <> '')"
    return f"""
        {name}_s as (select id, pos, unnest(ss) s, unnest(range(1, len(ss) + 1)) k from (select id, pos, {sentences} ss from {source} where {WORDS.format("p")} >= {T.BLOB_WORDS})),
        {name}_w as (select id, pos, s, k, {WORDS.format("s")} n from {name}_s),
        {name}_g as (
            select id, pos, k, s, n, 1 grp from {name}_w where k = 1
            union all
            select w.id, w.pos, w.k, w.s, case when g.n + w.n > {T.GROUP_WORDS} then w.n else g.n + w.n end, case when g.n + w.n > {T.GROUP_WORDS} then g.grp + 1 else g.grp end
            from {name}_g g join {name}_w w on w.id = g.id and w.pos = g.pos and w.k = g.k + 1),
        {name} as (
            select id, pos, 0 grp, p from {source} where {WORDS.format("p")} < {T.BLOB_WORDS}
            union all
            select id, pos, grp, string_agg(s, ' ' order by k) from {name}_g group by id, pos, grp)"""


def repeats(p: str) -> str:
    """Whether one paragraph of a list ends in twenty or more characters that start the next one."""
    return f"""len(list_filter(range(1, len({p})), lambda i: len(list_filter(range(20, least(length({p}[i]), length({p}[i + 1])) + 1),
        lambda k: right({p}[i], k) = left({p}[i + 1], k))) > 0)) > 0"""


def quality(p: str, w: str) -> str:
    """Final score of a list of paragraphs with ``w`` words."""
    h = f"len(regexp_extract_all(array_to_string({p}, chr(10)), '{S.HINTS}'))"
    length = f"case when {w} = 0 then 0e0 when {w} < 500 then {w} / 500 * 5e-1 when {w} > 15000 then 5e-1 else 5e-1 + least({w}, 2000) / 2000 * 5e-1 end"
    shape = f"case when len({p}) = 0 then 0e0 when len({p}) = 1 then 1e-1 when {w} / len({p}) > 500 then 3e-1 else 4e-1 + least(len({p}), 30) / 30 * 6e-1 end"
    clean = f"greatest(0e0, 1e0 - case when {h} > 0 then least({h} * 1e-1, 4e-1) else 0e0 end - case when {repeats(p)} then 2e-1 else 0e0 end)"
    return f"cast(round(cast(cast(35e-2 * {length} + 35e-2 * {shape} + 3e-1 * {clean} as varchar) as decimal(38, 20)), 4) as double)"


def cleaned(source: str, name: str) -> str:
    """CTEs that end in ``name`` (id, ps): cleaned paragraphs of ``source`` (id, title, ps). Rows without a paragraph left are missing."""
    near = ratio(f"{heading_key('title')}", f"{heading_key('p')}", T.HEADING_RATIO)
    return f"""
        {name}_in as (select id, unnest(ps) p, unnest(range(1, len(ps) + 1)) pos from {source}),
        {name}_ok as (select * from {name}_in where length(trim(p)) >= 3 and not regexp_matches(p, '{BAD}')),
        {split_blobs(name + "_ok", name + "_cut")},
        {name}_long as (select id, p, row_number() over (partition by id order by pos, grp) place from {name}_cut where {WORDS.format("p")} >= {T.MIN_WORDS}),
        {name}_kept as (
            select l.id, place, p from {name}_long l join {source} s on s.id = l.id
            where coalesce(title, '') = '' or place > {T.HEADING_WINDOW} or not (regexp_matches(trim(p), '{BARE}') or {near} >= {T.HEADING_RATIO})),
        {name} as (select id, list(p order by place) ps from {name}_kept group by id)"""
