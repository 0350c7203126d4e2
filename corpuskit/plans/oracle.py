"""DuckDB SQL that independently restates each registered query.

The driver runs these on the same parquet tables (registered as views) and
compares results with the Spark side.  Fragments here are SQL text only.
"""

from __future__ import annotations

from ..functions.text import PY_SPACE, UNI_SPACE

# Derived views, written as DuckDB SQL (must match corpuskit.sources.derived).
VIEWS = {
    "questions": r"""
        select conv_id*1000+turn as Id,
               ' ' || chr(9) || regexp_extract(text, '^[^.!?\n]*[.!?]?', 0) || chr(10) || ' ' as Title,
               '<p>' || replace(text, chr(10), '</p>' || chr(10) || '<p>') || '</p>' as Body,
               cast(floor(length(text) / 20.0) as integer) as Score
        from conversations where role = 'user'""",
    "answers": r"""
        select 1000000+conv_id*1000+turn as Id,
               conv_id*1000+turn-1 as ParentId,
               '<div><p>' || replace(regexp_replace(text, '^(\S+)', '<b>\1</b>'), chr(10),
                                     '</p>' || chr(10) || '<p>') || '</p></div>' as Body,
               cast(floor(length(text) / 20.0) as integer) as Score
        from conversations where role = 'assistant'""",
    "samples": r"""
        select l_orderkey*10+l_linenumber as sample_id,
               l_returnflag || l_linestatus as method,
               cast(l_quantity as integer) as num_tokens,
               l_extendedprice/10000.0 as latency,
               l_discount*100 as cpu_percent,
               l_tax*100 as memory_percent,
               case when l_discount = 0 then null else l_quantity*64 end as gpu_memory_mb,
               l_discount*10 as rouge1_f1,
               l_tax*10 as rouge2_f1,
               (l_discount+l_tax)*5 as rougeL_f1,
               case when l_returnflag = 'R' then null else l_discount*l_tax*100 end as bleu_score
        from lineitem""",
    "steps": r"""
        select user_id as run_id, event_id as step, ts, value as loss,
               cast(json_extract_string(props, '$.k') as double) / 10.0 as memory_gb,
               case when event_type = 'error' then null else value*100 end as gpu_memory_mb
        from events""",
    "logits": r"""
        select cast(floor(e.vec_id/16) as bigint) as sample_id, cast(e.vec_id % 16 as integer) as pos,
               e.embedding as student, t.embedding as teacher,
               case when e.label = 0 then -100 else e.label end as label
        from embeddings e join embeddings t on t.vec_id = e.vec_id + 1""",
    "pairs": r"""
        select c.conv_id*1000+c.turn as pair_id, c.text as reference, h.text as hypothesis
        from conversations c join conversations h on h.conv_id = c.conv_id + 1 and h.turn = c.turn""",
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named derived views (and extras)."""
    ctes = [f"{n} as ({VIEWS[n]})" for n in names]
    ctes += [f"{k} as ({v})" for k, v in (extra or {}).items()]
    return ("with " + ",\n".join(ctes) + "\n" + body) if ctes else body


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unicode_trim_sql(x: str, space_class: str = UNI_SPACE) -> str:
    return f"regexp_replace({x}, '^[{space_class}]+|[{space_class}]+$', '', 'g')"


def _decode_references_sql(s: str) -> str:
    """Character references decoded in one pass: split at ``&``; decode a
    numeric reference, a full name with ``;``, a legacy name, or the
    longest legacy prefix at the start of each piece (DuckDB list lambdas)."""
    import json
    from html.entities import html5

    values = {n.rstrip(";"): v for n, v in html5.items()}
    legacy = [n for n in html5 if not n.endswith(";")]
    # Windows-1252 text of the numbers 128 to 159; five of them have none
    c1_text = {n: (chr(n) if n in (129, 141, 143, 144, 157) else bytes([n]).decode("cp1252")) for n in range(128, 160)}
    full = f"cast(json({_lit(json.dumps(values))}) as map(varchar, varchar))"
    leg = f"cast(json({_lit(json.dumps({n: values[n] for n in legacy}))}) as map(varchar, varchar))"
    c1 = f"cast(json({_lit(json.dumps({str(k): v for k, v in c1_text.items()}))}) as map(varchar, varchar))"
    # pr = [piece, numeric match, name candidate (with optional ;), name]
    body = "regexp_replace(pr[2], ';$', '')"
    is_hex = f"(starts_with({body}, '#x') or starts_with({body}, '#X'))"
    digits = f"ltrim(regexp_extract({body}, '[0-9a-fA-F]+$'), '0')"
    cp = (f"(case when length({digits}) > (case when {is_hex} then 6 else 7 end) then 1114112 "
          f"when {digits} = '' then 0 "
          f"when {is_hex} then ('0x' || {digits})::bigint else {digits}::bigint end)")
    num = (f"(case when {cp} = 0 or {cp} > 1114111 or ({cp} >= 55296 and {cp} <= 57343) then chr(65533) "
           f"when {cp} >= 128 and {cp} <= 159 then map_extract_value({c1}, {cp}::varchar) "
           f"when ({cp} between 1 and 8) or {cp} = 11 or ({cp} between 14 and 31) or {cp} = 127 "
           f"or ({cp} between 64976 and 65007) or ({cp} & 65534) = 65534 then '' "
           f"else chr({cp}::integer) end)")
    prefix = " ".join(
        f"when length(pr[4]) > {k} and map_extract_value({leg}, left(pr[4], {k})) is not null "
        f"then map_extract_value({leg}, left(pr[4], {k})) || substr(pr[1], {k + 1})"
        for k in range(max(map(len, legacy)), 1, -1))
    dec = (f"case when pr[2] <> '' then {num} || substr(pr[1], length(pr[2]) + 1) "
           f"when ends_with(pr[3], ';') and map_extract_value({full}, pr[4]) is not null "
           f"then map_extract_value({full}, pr[4]) || substr(pr[1], length(pr[3]) + 1) "
           f"when map_extract_value({leg}, pr[4]) is not null "
           f"then map_extract_value({leg}, pr[4]) || substr(pr[1], length(pr[4]) + 1) "
           f"{prefix} else '&' || pr[1] end")
    tagged = ("list_transform((string_split({s}, '&'))[2:], lambda p: [p, "
              "regexp_extract(p, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?'), "
              "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;?'), "
              "regexp_replace(regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;?'), ';$', '')])").replace("{s}", s)
    pieces = f"list_transform({tagged}, lambda pr: {dec})"
    return (f"(case when instr({s}, '&') > 0 then (string_split({s}, '&'))[1] || array_to_string({pieces}, '') "
            f"else {s} end)")


def html_to_text_sql(x: str) -> str:
    """The HTML text rule restated as DuckDB (RE2) regex and list steps."""
    s = f"coalesce({x}, '')"
    for t in ("script", "style", "template", "rt", "rp"):
        end = f"(?:</{t}\\s*>|\\z)" if t in ("script", "style") else f"</{t}\\s*>"
        cut = f"(?is)<{t}\\b[^>]*>.*?{end}"
        # the first of comments and this element goes first, as they may hold one another
        s = f"regexp_replace({s}, '(?s)<!--.*?-->|{cut}', chr(64976), 'g')"
    s = f"regexp_replace({s}, '<[a-zA-Z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>|<[a-zA-Z/!?][^>]*>', chr(64976), 'g')"
    s = _decode_references_sql(s)
    s = f"regexp_replace({s}, '[{PY_SPACE}]*\\x{{FDD0}}[{PY_SPACE}\\x{{FDD0}}]*', ' ', 'g')"
    return f"regexp_replace({s}, '^[{PY_SPACE}]+|[{PY_SPACE}]+$', '', 'g')"
