"""SQL of the searches with edits: the edit matrix as bit strings over whole texts, a pattern letter a step."""

from __future__ import annotations

from amplispark.functions import dna

# The bases each code stands for, A = 1, C = 2, G = 4, T = 8.
CODES = {"A": 1, "C": 2, "G": 4, "T": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
#: For each code of a pattern the letters of text that may stand for one of its bases.
CLASSES = ", ".join(f"('{c}', '{''.join(t for t, v in (*CODES.items(), ('U', 8)) if v & b)}')" for c, b in CODES.items())
RC = "reverse(translate(regexp_replace({0}, '[^" + dna.LETTERS + "]', 'N', 'g'), '" + dna.LETTERS + "', '" + dna.COMPLEMENTS + "'))"
_CLEAN = "CASE WHEN regexp_full_match(upper(trim({0}, chr(32) || chr(9) || chr(10) || chr(13))), '[ACGTRYSWKMBDHVN]+') THEN upper(trim({0}, chr(32) || chr(9) || chr(10) || chr(13))) END"


def _step(k: int, mask: str) -> str:
    """The bit strings after one more letter of the pattern; bit e of r_d: the prefix read so far ends at e with at most d edits."""
    out = [f"((r0 >> 1) & {mask})"]
    for d in range(1, k + 1):
        out.append(f"(((r{d} >> 1) & {mask}) | (r{d - 1} >> 1) | r{d - 1} | ({out[-1]} >> 1))")
    return ", ".join(f"{x} AS r{d}" for d, x in enumerate(out))


def _cost(k: int, at: str, of: str = "") -> str:
    """The least number of edits at a position, more than k if there is none."""
    cases = " ".join(f"WHEN get_bit({of}r{d}, CAST({at} AS INTEGER)) = 1 THEN {d}" for d in range(k + 1))
    return f"(CASE {cases} ELSE {k + 9} END)"


def search(p: str, texts: str, queries: str, k: int) -> str:
    """CTEs that end in {p}_m (tid, qid, m, a, e, d, cigar): the reported matches of patterns (queries: tid, qid, pat) in texts (tid, txt)."""
    rs = ", ".join(f"r{d}" for d in range(k + 1))
    ones = ", ".join(f"CAST(repeat('1', length(t.txt) + 1) AS BIT) AS r{d}" for d in range(k + 1))
    anchored = ", ".join(f"CAST(rpad(repeat('1', least({d}, l) + 1), CAST(l + 1 AS INTEGER), '0') AS BIT) AS r{d}" for d in range(k + 1))
    ctes = f"""
{p}_mask AS MATERIALIZED (SELECT t.tid, code, '0' || regexp_replace(regexp_replace(t.txt, '[' || letters || ']', '1', 'g'), '[^1]', '0', 'g') AS bits FROM {texts} t, classes
  WHERE t.tid IN (SELECT tid FROM {queries})),
{p}_run AS (SELECT t.tid, q.qid, q.pat, 0 AS i, {ones} FROM {queries} q JOIN {texts} t ON t.tid = q.tid
  UNION ALL SELECT tid, qid, pat, i + 1, {rs} FROM (SELECT n.tid, n.qid, n.pat, n.i, {_step(k, 'CAST(b.bits AS BIT)')}
    FROM {p}_run n JOIN {p}_mask b ON b.tid = n.tid AND b.code = substr(n.pat, CAST(n.i + 1 AS BIGINT), 1) WHERE n.i < length(n.pat)) WHERE bit_count(r{k}) > 0),
{p}_hit AS (SELECT * FROM (SELECT tid, qid, pat, e, {_cost(k, 'e')} AS d FROM (SELECT *, unnest(range(1, bit_length(r{k}))) AS e FROM {p}_run WHERE i = length(pat))) WHERE d <= {k}),
{p}_new AS (SELECT *, coalesce(lag(e) OVER w <> e - 1 OR lag(d) OVER w <> d, true) AS fresh, lag(e) OVER w AS e0, lag(d) OVER w AS d0, lead(e) OVER w AS e1, lead(d) OVER w AS d1 FROM {p}_hit WINDOW w AS (PARTITION BY tid, qid ORDER BY e)),
{p}_grp AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY tid, qid ORDER BY e) AS run FROM {p}_new),
{p}_end AS MATERIALIZED (SELECT tid, qid, any_value(pat) AS pat, length(any_value(pat)) AS m, max(e) AS e, any_value(d) AS d FROM {p}_grp GROUP BY tid, qid, run
  HAVING NOT coalesce(min(CASE WHEN fresh AND e0 = e - 1 AND d0 < d THEN 1 END), 0) = 1 AND NOT coalesce(arg_max(CASE WHEN e1 = e + 1 AND d1 < d THEN 1 ELSE 0 END, e), 0) = 1)"""
    if not k:
        return ctes + f""",
{p}_m AS (SELECT tid, qid, m, e - m AS a, e, d, CAST(m AS VARCHAR) || '=' AS cigar FROM {p}_end)"""
    return ctes + f""",
{p}_dp AS MATERIALIZED (WITH RECURSIVE dp AS (
  SELECT tid, qid, pat, e, d, l, 0 AS i, CAST(repeat('0', CAST(l + 1 AS INTEGER)) AS BIT) AS own, {anchored} FROM (SELECT *, unnest(range(greatest(m - d, 1), least(m + d, e) + 1)) AS l FROM {p}_end)
  UNION ALL SELECT tid, qid, pat, e, d, l, i + 1, own, {rs} FROM (SELECT n.tid, n.qid, n.pat, n.e, n.d, n.l, n.i, CAST('0' || substr(b.bits, CAST(n.e - n.l + 2 AS BIGINT), CAST(n.l AS BIGINT)) AS BIT) AS own,
    {_step(k, "CAST('0' || substr(b.bits, CAST(n.e - n.l + 2 AS BIGINT), CAST(n.l AS BIGINT)) AS BIT)")}
    FROM dp n JOIN {p}_mask b ON b.tid = n.tid AND b.code = substr(n.pat, CAST(n.i + 1 AS BIGINT), 1) WHERE n.i < length(n.pat)))
  SELECT * FROM dp),
{p}_best AS MATERIALIZED (SELECT tid, qid, pat, e, d, arg_min(l, abs(l - length(pat)) * 100 + l) AS l FROM {p}_dp WHERE i = length(pat) AND {_cost(k, 'l')} = d GROUP BY tid, qid, pat, e, d),
{p}_way AS (WITH RECURSIVE way AS (
  SELECT tid, qid, e, l, length(pat) AS i, l AS j, d AS c, '' AS ops FROM {p}_best
  UNION ALL SELECT tid, qid, e, l, CASE WHEN op = 'D' THEN i ELSE i - 1 END, CASE WHEN op = 'I' THEN j ELSE j - 1 END, CASE WHEN op = '=' THEN c ELSE c - 1 END, op || ops FROM (
    SELECT w.*, CASE WHEN w.i > 0 AND w.j > 0 AND get_bit(h.own, CAST(w.j AS INTEGER)) = 1 AND {_cost(k, 'greatest(w.j - 1, 0)', 'u.')} = w.c THEN '='
      WHEN w.i > 0 AND w.j > 0 AND get_bit(h.own, CAST(w.j AS INTEGER)) = 0 AND {_cost(k, 'greatest(w.j - 1, 0)', 'u.')} + 1 = w.c THEN 'X'
      WHEN w.i > 0 AND {_cost(k, 'w.j', 'u.')} + 1 = w.c THEN 'I' ELSE 'D' END AS op
    FROM way w JOIN {p}_dp h ON h.tid = w.tid AND h.qid = w.qid AND h.e = w.e AND h.l = w.l AND h.i = w.i
    JOIN {p}_dp u ON u.tid = w.tid AND u.qid = w.qid AND u.e = w.e AND u.l = w.l AND u.i = greatest(w.i - 1, 0) WHERE w.i > 0 OR w.j > 0))
  SELECT * FROM way WHERE i = 0 AND j = 0),
{p}_ops AS (SELECT tid, qid, e, l, unnest(regexp_extract_all(ops, '=+|X+|I+|D+')) AS part, generate_subscripts(regexp_extract_all(ops, '=+|X+|I+|D+'), 1) AS nth FROM {p}_way),
{p}_cig AS (SELECT tid, qid, e, string_agg(CAST(length(part) AS VARCHAR) || part[1], '' ORDER BY nth) AS cigar FROM {p}_ops GROUP BY tid, qid, e),
{p}_m AS (SELECT b.tid, b.qid, length(b.pat) AS m, b.e - b.l AS a, b.e, b.d, c.cigar FROM {p}_best b JOIN {p}_cig c ON c.tid = b.tid AND c.qid = b.qid AND c.e = b.e)"""


_TABLES = rf"""WITH RECURSIVE classes AS (SELECT * FROM (VALUES {CLASSES}) AS t(code, letters)),
pr AS MATERIALIZED (SELECT row_number() OVER (ORDER BY primer_idx, name) - 1 AS idx, name, {_CLEAN.format('forward')} AS f, {_CLEAN.format('reverse')} AS v FROM primers),
po AS MATERIALIZED (SELECT row_number() OVER (ORDER BY primer_idx, name) - 1 AS idx, name, {_CLEAN.format('sequence')} AS f FROM pool_primers),
s AS MATERIALIZED (SELECT seq_id AS rec_id, header, upper(sequence) AS s FROM sequences WHERE length(sequence) > 0)"""


def matches(k: int, rc: bool = False, identity: float = 0.0) -> str:
    """matches() of both arms of all pairs and of the pool, in this order."""
    arms = """arms AS (SELECT idx, f AS pat FROM pr UNION ALL SELECT idx + (SELECT count(*) FROM pr), v FROM pr UNION ALL SELECT idx + 2 * (SELECT count(*) FROM pr), f FROM po)"""
    strands = f"arm_set AS (SELECT idx * 2 AS qid, pat FROM arms WHERE pat IS NOT NULL{' UNION ALL SELECT idx * 2 + 1, ' + RC.format('pat') + ' FROM arms WHERE pat IS NOT NULL' if rc else ''})"
    return f"""{_TABLES}, {arms}, {strands}, t AS (SELECT rec_id AS tid, s AS txt FROM s), q AS (SELECT tid, qid, pat FROM t, arm_set),
{search('h', 't', 'q', k)}
SELECT tid AS rec_id, CAST(qid // 2 AS BIGINT) AS primer_idx, CAST(a AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(d AS INTEGER) AS edit_distance, CASE WHEN qid % 2 = 1 THEN '-' ELSE '+' END AS strand, cigar, (m - d) / m AS identity
FROM h_m WHERE (m - d) / m >= {identity}"""


def products(pool: bool, k: int = 0, rc: bool = False, circular: bool = False, trim: bool = False, self_match: bool = False, min_len: int = 50, max_len: int = 2000, n: float = 0.1) -> str:
    """CTEs that end in `found`: the products of pairs or of a pool, as flattened() gives them, with reference_header."""
    txt = f"x || substr(x, 1, {max(max_len - 1, 0)})" if circular else "x"
    texts = f"""t AS MATERIALIZED (SELECT rec_id * 2 + back AS tid, rec_id, header, back, length(x) AS len, {txt} AS txt FROM (
  SELECT rec_id, header, 0 AS back, s AS x FROM s{' UNION ALL SELECT rec_id, header, 1, ' + RC.format('s') + ' FROM s' if rc else ''}))"""
    if pool:
        body = f"""{texts}, qf AS (SELECT tid, idx AS qid, f AS pat FROM t, po WHERE f IS NOT NULL), qv AS (SELECT tid, idx AS qid, {RC.format('f')} AS pat FROM t, po WHERE f IS NOT NULL),
{search('f', 't', 'qf', k)},
{search('v', 't', 'qv', k)},
pairs AS (SELECT f.tid, f.qid AS i, v.qid AS j, a.name || '+' || b.name AS primer_name, f.a AS fa, f.e AS fe, f.d AS fd, f.m AS fm, f.cigar AS fc, v.a AS va, v.e AS ve, v.d AS vd, v.m AS vm, v.cigar AS vc
  FROM f_m f JOIN v_m v ON v.tid = f.tid AND v.e > f.a AND v.e BETWEEN f.a + {min_len} AND f.a + {max_len}{'' if self_match else ' AND v.qid <> f.qid'} JOIN po a ON a.idx = f.qid JOIN po b ON b.idx = v.qid)"""
    else:
        body = f"""{texts}, qf AS (SELECT tid, idx AS qid, f AS pat FROM t, pr WHERE f IS NOT NULL AND v IS NOT NULL),
{search('f', 't', 'qf', k)},
ff AS MATERIALIZED (SELECT row_number() OVER () AS fid, f.*, substr(t.txt, CAST(f.e + 1 AS BIGINT), CAST(f.a + {max_len} - f.e AS BIGINT)) AS txt FROM f_m f JOIN t ON t.tid = f.tid WHERE f.e < least(f.a + {max_len}, length(t.txt))),
tv AS (SELECT fid AS tid, txt FROM ff), qv AS (SELECT fid AS tid, qid, {RC.format('p.v')} AS pat FROM ff JOIN pr p ON p.idx = ff.qid),
{search('v', 'tv', 'qv', k)},
pairs AS (SELECT f.tid, f.qid AS i, f.qid AS j, p.name AS primer_name, f.a AS fa, f.e AS fe, f.d AS fd, f.m AS fm, f.cigar AS fc, v.a + f.e AS va, v.e + f.e AS ve, v.d AS vd, v.m AS vm, v.cigar AS vc
  FROM ff f JOIN v_m v ON v.tid = f.fid JOIN pr p ON p.idx = f.qid WHERE v.e + f.e - f.a BETWEEN {min_len} AND {max_len})"""
    a, b = ("fe", "va") if trim else ("fa", "ve")
    return f"""{_TABLES}, {body},
cut AS (SELECT p.*, t.rec_id, t.header, t.back, t.len, substr(t.txt, CAST({a} + 1 AS BIGINT), CAST({b} - {a} AS BIGINT)) AS sequence FROM pairs p JOIN t ON t.tid = p.tid WHERE {a} < {b}),
found AS (SELECT rec_id, header AS reference_header, CAST(i AS BIGINT) AS primer_idx, CAST(j AS BIGINT) AS rev_idx, primer_name, sequence, CAST(ve - fa AS BIGINT) AS full_length, CASE back WHEN 1 THEN '-' ELSE '+' END AS strand,
  {'ve - 1 >= len' if circular else 'false'} AS is_circular_wrap,
  CAST(CASE back WHEN 1 THEN greatest(len - {b} % len, 0) ELSE {a} % len END AS BIGINT) AS original_start, CAST(CASE back WHEN 1 THEN greatest(len - {a} % len, 0) ELSE {b} % len END AS BIGINT) AS original_end,
  CAST(fa AS BIGINT) AS fwd_start, CAST(fe AS BIGINT) AS fwd_end, CAST(fd AS INTEGER) AS fwd_mismatches, (fm - fd) / fm AS fwd_identity, fc AS fwd_cigar,
  CAST(va AS BIGINT) AS rev_start, CAST(ve AS BIGINT) AS rev_end, CAST(vd AS INTEGER) AS rev_mismatches, (vm - vd) / vm AS rev_identity, vc AS rev_cigar
  FROM cut WHERE (length(sequence) - length(replace(sequence, 'N', ''))) / length(sequence) <= {n})"""


_ORDER = "rec_id, primer_idx, strand DESC, fwd_end, fwd_start, rev_idx, rev_end, rev_start"
_ORDER = _ORDER.replace("strand DESC", "CASE strand WHEN '+' THEN 0 ELSE 1 END")


def plain(**kinds) -> str:
    """The products as found."""
    return products(**kinds) + "\nSELECT * EXCLUDE (reference_header) FROM found"


def numbered(per_call: bool = False, distinct: bool = False, **kinds) -> str:
    """The products with case numbers, without duplicates if so wished."""
    first = f"SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY reference_header, least(sequence, {RC.format('sequence')}) ORDER BY {_ORDER}) = 1" if distinct else "SELECT * FROM found"
    scope = "rec_id, primer_idx" if per_call else "reference_header"
    return products(**kinds) + f",\nleft_over AS ({first})\nSELECT * EXCLUDE (reference_header), row_number() OVER (PARTITION BY {scope} ORDER BY {_ORDER}) AS case_number FROM left_over"


#: The usable pairs in order, names trimmed, numbered from 0.
INLINE = _TABLES.split(",\npo AS")[0] + """
SELECT CAST(row_number() OVER (ORDER BY idx) - 1 AS BIGINT) AS primer_idx, trim(name) AS name, f AS forward, upper(trim((SELECT any_value(reverse) FROM primers p WHERE p.primer_idx = u.primer_idx))) AS reverse
FROM (SELECT pr.*, p.primer_idx FROM pr JOIN (SELECT row_number() OVER (ORDER BY primer_idx, name) - 1 AS idx, primer_idx FROM primers) p USING (idx)) u WHERE f IS NOT NULL AND v IS NOT NULL AND name NOT LIKE '%:%' AND name NOT LIKE '%;%'"""
