"""Longer SQL twins of queries, and what they are put together from."""

from __future__ import annotations

from logsluice.llm.common import WORD
from logsluice.llm.minhash import NO_WORD, factors

#: CTE ``steps`` with the 256 remainders of CRC-32, from its polynomial.
CRC_STEPS = """steps AS (
          SELECT list(crc ORDER BY b) AS crcs FROM (
            SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k:
              CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS crc
            FROM (SELECT unnest(range(256)) AS b)))"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text; ``steps`` must be among the tables."""
    read = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, {read}), lambda c, b:
            xor(c // 256, crcs[xor(c % 256, b) + 1])))"""


def xxh64(rows: str, value: str, name: str) -> str:
    """SQL for the columns of ``rows`` and ``name``, the XXH64 (seed 42) of this 64-bit number. The five factors are
    fixed values of XXH64."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (
        11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    whole = f"{1 << 64}::UHUGEINT"

    def turned(x: str, by: int) -> str:
        return f"(({x} * {1 << by}::UHUGEINT) % {whole} + {x} // {1 << (64 - by)}::UHUGEINT)"

    steps = [
        f"({value}::UHUGEINT * {p2}) % {whole}",
        f"xor(42::UHUGEINT + {p5} + 8::UHUGEINT, ({turned('_s0', 31)} * {p1}) % {whole})",
        f"(({turned('_s1', 27)} * {p1}) % {whole} + {p4}) % {whole}",
        f"(xor(_s2, _s2 // {1 << 33}::UHUGEINT) * {p2}) % {whole}",
        f"(xor(_s3, _s3 // {1 << 29}::UHUGEINT) * {p3}) % {whole}",
    ]
    sql = rows
    for n, step in enumerate(steps):
        sql = f"(SELECT *, {step} AS _s{n} FROM {sql})"
    return f"SELECT * EXCLUDE (_s0, _s1, _s2, _s3, _s4), xor(_s4, _s4 // {1 << 32}::UHUGEINT) AS {name} FROM {sql}"


def _near(a: str, b: str) -> str:
    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = repeat('0', 256) OR {b} = repeat('0', 256) THEN 0.0::DOUBLE
            ELSE greatest(0.0::DOUBLE, (len(list_filter(range(1, 257), lambda i: substr({a}, i, 1) = substr({b}, i, 1))) - 16) / 240.0::DOUBLE) END"""


FINGERPRINTS = f"""
        WITH {CRC_STEPS},
        docs AS (
          SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n
          FROM documents),
        pairs AS (
          SELECT *, coalesce(lead(r) OVER (ORDER BY r), 1) AS next_r, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS after
          FROM docs),
        texts AS (
          SELECT r, false AS edited, t FROM pairs
          UNION ALL SELECT r, true, left(t, n - n // 4) || left(after, n // 4) FROM pairs),
        placed AS (
          SELECT r, edited, unnest(w) AS word, generate_subscripts(w, 1) AS i
          FROM (SELECT r, edited, regexp_extract_all(t, '{WORD}') AS w FROM texts)),
        sums AS (SELECT word, {crc32('word')} AS crc FROM (SELECT DISTINCT word FROM placed), steps),
        lists AS MATERIALIZED (SELECT r, edited, list(crc % {NO_WORD} ORDER BY i) AS s FROM placed JOIN sums USING (word) GROUP BY r, edited),
        runs AS (SELECT r, edited, s, unnest(range(1, greatest(len(s) - 4, 1) + 1)) AS i FROM lists),
        shingles AS (
          SELECT r, edited, {" + ".join(f"coalesce(s[i + {k}], {NO_WORD}) * {by}" for k, by in enumerate(factors(5)))} AS x FROM runs),
        hashed AS ({xxh64("shingles", "x", "h")}),
        least AS MATERIALIZED (
          SELECT r, edited, CAST(h // {1 << 55} AS INTEGER) AS bin, min(h) AS h
          FROM (SELECT r, edited, h % {1 << 63}::UHUGEINT AS h FROM hashed) GROUP BY ALL),
        looks AS MATERIALIZED (
          SELECT x // 8 AS i, x % 8 + 1 AS k, CAST(h % 256 AS INTEGER) AS bin
          FROM ({xxh64("(SELECT unnest(range(2048)) AS x)", "x", "h")})
          UNION ALL SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i)),
        ranks AS MATERIALIZED (
          SELECT x // 256 AS i, x % 256 AS bin, (h % {1 << 63}::UHUGEINT) // 16 AS rank
          FROM ({xxh64("(SELECT unnest(range(65536)) AS x)", "x", "h")})),
        seen AS MATERIALIZED (
          SELECT r, edited, i, arg_min(CAST(h % 16 AS INTEGER), k) AS digit FROM least JOIN looks USING (bin) GROUP BY ALL),
        missing AS (
          SELECT r, edited, unnest(range(256)) AS i FROM lists EXCEPT SELECT r, edited, i FROM seen),
        filled AS (
          SELECT * FROM seen UNION ALL
          SELECT r, edited, i, min(rank * 16 + h % 16) % 16 FROM missing JOIN least USING (r, edited) JOIN ranks USING (i, bin) GROUP BY ALL),
        prints AS (
          SELECT r, edited, string_agg(substr('0123456789abcdef', CAST(digit AS INTEGER) + 1, 1), '' ORDER BY i) AS print
          FROM filled GROUP BY ALL),
        all_prints AS (
          SELECT r, edited, coalesce(print, repeat('0', 256)) AS print FROM texts LEFT JOIN prints USING (r, edited)),
        joined AS (
          SELECT p.doc_id, p.n, p.t, p.after, o.print AS own, e.print AS changed, f.print AS later
          FROM pairs p JOIN all_prints o ON o.r = p.r AND NOT o.edited JOIN all_prints e ON e.r = p.r AND e.edited
            JOIN all_prints f ON f.r = p.next_r AND NOT f.edited)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 4) || left(after, n // 4)) AS edited_sha256,
          own AS fingerprint, changed AS edited_fingerprint, {_near("own", "changed")} AS near_edited, {_near("own", "later")} AS near_next
        FROM joined"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CONVERSATIONS = f"""
        WITH RECURSIVE {CRC_STEPS},
        convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
        hit AS (
          SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32("coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault
          FROM conversations v JOIN convs ON v.conv_id IS NOT DISTINCT FROM convs.conv_id, steps),
        damaged AS (
          SELECT c, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
            CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
            unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
          FROM hit),
        line AS (
          SELECT *, left(role, 1) AS initial, rtrim(text, {_WHITE}) AS bare,
            row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i,
            row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
          FROM damaged),
        judged AS (
          SELECT *, bare = '' OR again AS must_go, bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS cut_off,
            lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
          FROM line),
        counted AS (
          SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (bare = '') AS blank,
            count(*) FILTER (bare <> '' AND again) AS duplicate, count(*) FILTER (cut_off AND NOT again) AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
          FROM judged GROUP BY c),
        inserted(start, state, price, more) AS (
          VALUES ('', '', 0, ''), ('', 'u', 2, 'I'), ('', 'a', 4, 'II'), ('s', 's', 0, ''), ('s', 'u', 2, 'I'), ('s', 'a', 4, 'II'),
            ('u', 'u', 0, ''), ('u', 'a', 2, 'I'), ('a', 'a', 0, ''), ('a', 'u', 2, 'I')),
        ways AS (
          SELECT c, i, start, price, more, state, unnest([
            {{s: state, p: 3, l: 'D'}},
            CASE WHEN NOT must_go THEN {{s: CASE state WHEN 'u' THEN 'a' ELSE 'u' END, p: 2 + CAST(cut_off AS INTEGER), l: 'R'}} END,
            CASE WHEN NOT must_go AND (initial = CASE state WHEN 'u' THEN 'a' ELSE 'u' END OR initial = 's' AND state = '')
              THEN {{s: initial, p: CAST(cut_off AS INTEGER), l: 'K'}} END]) AS w
          FROM judged, inserted),
        walk AS (
          SELECT c, CAST(0 AS BIGINT) AS i, '' AS state, {{p: 0, l: ''}} AS best FROM convs
          UNION ALL
          SELECT k.c, k.i + 1, w.w.s, min({{p: k.best.p + w.price + w.w.p, l: k.best.l || w.more || w.w.l}})
          FROM walk k JOIN ways w ON w.c = k.c AND w.i = k.i + 1 AND w.start = k.state WHERE w.w IS NOT NULL GROUP BY k.c, k.i, w.w.s),
        ended AS (
          SELECT c, min({{p: best.p + price, l: best.l || more}}) AS best
          FROM walk JOIN (SELECT c, max(i) AS i FROM walk GROUP BY c) USING (c, i) JOIN inserted ON inserted.start = walk.state
          WHERE inserted.state IN ('', 'a') GROUP BY c),
        letters AS (SELECT c, best.l AS audit, unnest(range(1, length(best.l) + 1)) AS j FROM ended),
        edits AS (
          SELECT c, j, substr(audit, j, 1) AS letter, length(replace(left(audit, j), 'I', '')) AS i,
            length(replace(left(audit, j), 'D', '')) AS k
          FROM letters),
        kept AS (
          SELECT e.*, r.role, r.text, max(e.k = 1 AND e.letter = 'K' AND r.initial = 's') OVER (PARTITION BY e.c) AS with_system
          FROM edits e LEFT JOIN judged r ON r.c = e.c AND r.i = e.i AND e.letter <> 'I' WHERE e.letter <> 'D'),
        repaired AS (
          SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - CAST(with_system AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END
            || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS lines
          FROM kept GROUP BY c)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
          coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.p AS BIGINT) AS cost, best.l AS audit,
          sha256(coalesce(lines, '')) AS repaired_sha256
        FROM convs JOIN ended USING (c) LEFT JOIN counted USING (c) LEFT JOIN repaired USING (c)"""
