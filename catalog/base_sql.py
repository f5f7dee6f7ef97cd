"""SQL counterparts of ``catalog.shapes`` as common table expressions."""

from catalog.shapes import EXTENSIONS, HOSTS
from sessionlens.functions import content
from sessionlens.operators.directory import STATIC_COLUMNS, TRAITS


def uid(c: str) -> str:
    return f"('U' || lpad(CAST({c} AS VARCHAR), 7, '0'))"


EV = """ev AS (
  SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, value, length(props) AS n,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events),
base AS (
  SELECT event_id, 'E' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, ts, """ + uid("user_id") + """ AS usr,
         'PC-' || CAST(k % 3 AS VARCHAR) AS pc,
         CASE WHEN event_type IN ('signup', 'error') THEN 'logon' WHEN event_type IN ('click', 'purchase') THEN 'device'
              WHEN event_id % 3 = 0 THEN 'http' WHEN event_id % 3 = 1 THEN 'email' ELSE 'file' END AS log,
         CASE event_type WHEN 'signup' THEN 'Logon' WHEN 'error' THEN 'Logoff' WHEN 'click' THEN 'Connect'
              WHEN 'purchase' THEN 'Disconnect' END AS activity, value, k, n
  FROM ev)"""

_url = "url"
for _n, _h in HOSTS.items():
    _url = f"CASE WHEN page_id % 20 = {_n} THEN regexp_replace(url, '//[^/]+/', '//{_h}/') ELSE {_url} END"
WEB = f"web AS (SELECT page_id, {_url} AS url, regexp_replace(html, '[\\r\\n]+', ' ', 'g') AS content FROM pages)"

_ext = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))
FILES = f"""files AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 5 = 0 THEN 'D' WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'R' END || ':\\' || p_brand || '\\'
           || p_name || '.' || CASE p_partkey % 15 {_ext} END AS filename,
         CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS content
  FROM part)"""


def _listed(part: int, name: str) -> str:
    return f"string_agg(a, ';' ORDER BY l_linenumber, a) FILTER (WHERE l_linenumber % 3 = {part}) AS \"{name}\""


MAILS = f"""lines AS (
  SELECT l_orderkey, l_linenumber,
         's' || CAST(l_suppkey AS VARCHAR) || CASE WHEN s_nationkey < 12 THEN '@dtaa.com' ELSE '@ext.org' END AS a
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
lists AS (SELECT l_orderkey, {_listed(0, 'to')}, {_listed(1, 'cc')}, {_listed(2, 'bcc')}, count(*) AS n
          FROM lines GROUP BY l_orderkey),
mails AS (
  SELECT o_orderkey, "to", cc, bcc, {uid('o_custkey')} || '@dtaa.com' AS "from",
         CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS size, CAST(coalesce(n, 0) % 4 AS VARCHAR) AS att,
         CASE WHEN o_orderkey % 10 <> 0 THEN concat_ws(' ', o_orderpriority, o_orderstatus) END AS content
  FROM orders LEFT JOIN lists ON o_orderkey = l_orderkey)"""

UNIFIED = """unified AS (
  SELECT b.id, b.ts AS date, b.usr, b.pc, b.log AS type, b.activity, w.url, f.filename,
         coalesce(w.content, f.content, m.content) AS content, m."to", m.cc, m.bcc, m."from", m.size, m.att,
         CAST(floor(date_diff('day', (SELECT CAST(d AS DATE) - CAST(dayofweek(d) AS INTEGER) FROM
              (SELECT min(ts) AS d FROM base WHERE log = 'http')), CAST(b.ts AS DATE)) / 7) AS INTEGER) AS week
  FROM base b
  LEFT JOIN web w ON b.log = 'http' AND w.page_id = b.event_id % (SELECT count(*) FROM pages)
  LEFT JOIN files f ON b.log = 'file' AND f.p_partkey = b.event_id % (SELECT count(*) FROM part)
  LEFT JOIN mails m ON b.log = 'email' AND m.o_orderkey = b.event_id % (SELECT count(*) FROM orders))"""
LOGS = [EV, WEB, FILES, MAILS, UNIFIED]

# --- row features ---------------------------------------------------------------------------


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def occurrences(c: str, s: str) -> str:
    return f"(length({c}) - length(replace({c}, '{s}', '')))"


def domain(url: str) -> str:
    host = f"replace(regexp_extract(coalesce({url}, ''), '//(.*?)/', 1), 'www.', '')"
    tail = f"regexp_extract({host}, '([^.]+\\.[^.]+)$', 1)"
    deep = f"{occurrences(host, '.')} >= 2 AND NOT regexp_matches({host}, '{content.KEEP_SUBDOMAIN}')"
    return f"CASE WHEN {deep} AND {tail} <> '' THEN {tail} ELSE {host} END"


def category(d: str, url: str) -> str:
    return (
        f"CASE WHEN {d} IN {_in(content.CLOUD_SITES)} THEN 3 WHEN {d} IN {_in(content.LEAK_SITES)} THEN 5 "
        f"WHEN {d} IN {_in(content.SOCIAL_SITES)} THEN 2 "
        f"WHEN {d} IN {_in(content.JOB_SITES)} OR (contains({d}, 'job') AND regexp_matches({d}, 'hunt|search')) "
        f"OR (contains({d}, 'aol.com') AND regexp_matches({url}, 'recruit|job')) THEN 4 "
        f"WHEN {d} IN {_in(content.HACK_SITES)} OR contains({d}, 'keylog') THEN 6 ELSE 1 END"
    )


def recipients(c: str) -> str:
    return f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 0 ELSE {occurrences(c, ';')} + 1 END"


def internal(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, 'dtaa.com')), 0)"


def extension(c: str) -> str:
    return f"CASE WHEN regexp_extract(coalesce({c}, ''), '\\.([^.]+)$', 1) = '' THEN 'unknown' " \
           f"ELSE lower(regexp_extract({c}, '\\.([^.]+)$', 1)) END"


def file_type(ext: str) -> str:
    return "CASE " + " ".join(f"WHEN {ext} IN {_in(v)} THEN {k}" for k, v in content.FILE_TYPES.items()) + " ELSE 1 END"


def disk(c: str) -> str:
    return f"CASE WHEN {c} LIKE 'C%' THEN 1 WHEN {c} LIKE 'R%' THEN 2 ELSE 0 END"


_ext_of = f"(CASE WHEN TRUE THEN {extension('filename')} END)"
FEATURE_SQL = {
    "file_type": ("file", file_type(_ext_of)),
    "file_len": ("file", "length(coalesce(content, ''))"),
    "file_nwords": ("file", occurrences("coalesce(content, '')", " ") + " + 1"),
    "disk": ("file", disk("filename")),
    "file_depth": ("file", occurrences("filename", "\\")),
    "http_type": ("http", category("dom", "url")),
    "url_len": ("http", "length(url)"),
    "url_depth": ("http", f"greatest(0, {occurrences('url', '/')} - 2)"),
    "http_c_len": ("http", "length(coalesce(content, ''))"),
    "http_c_nwords": ("http", occurrences("coalesce(content, '')", " ") + " + 1"),
    "n_des": ("email", f"({recipients('\"to\"')}) + ({recipients('cc')}) + ({recipients('bcc')})"),
    "n_atts": ("email", "CAST(coalesce(att, '0') AS BIGINT)"),
    "n_exdes": ("email", f"({recipients('\"to\"')}) + ({recipients('cc')}) + ({recipients('bcc')}) "
                         f"- {internal('\"to\"')} - {internal('cc')} - {internal('bcc')}"),
    "n_bccdes": ("email", recipients("bcc")),
    "exbccmail": ("email", f"CASE WHEN ({recipients('bcc')}) - {internal('bcc')} > 0 THEN 1 ELSE 0 END"),
    "email_size": ("email", "CAST(coalesce(size, '0') AS BIGINT)"),
    "email_text_slen": ("email", "length(coalesce(content, ''))"),
    "email_text_nwords": ("email", "CASE WHEN trim(coalesce(content, '')) = '' THEN 0 ELSE "
                                   + occurrences("content", " ") + " + 1 END"),
}
FEATURE_SQL["Xemail"] = ("email", f"CASE WHEN {FEATURE_SQL['n_exdes'][1]} > 0 THEN 1 ELSE 0 END")

TIME_CODE = (
    "1 + CASE WHEN hour({0}) * 60 + minute({0}) < 450 OR hour({0}) * 60 + minute({0}) > 1050 THEN 1 ELSE 0 END"
    " + 2 * CASE WHEN isodow({0}) >= 6 THEN 1 ELSE 0 END"
)
ACT = ("CASE coalesce(lower(trim(activity)), type) WHEN 'logon' THEN 1 WHEN 'logoff' THEN 2 WHEN 'connect' THEN 3 "
       "WHEN 'disconnect' THEN 4 WHEN 'http' THEN 5 WHEN 'email' THEN 6 WHEN 'file' THEN 7 ELSE 0 END")
_feature_list = ",\n    ".join(
    f"CASE WHEN type = '{log}' THEN {e} ELSE 0 END AS \"{n}\"" for n, (log, e) in FEATURE_SQL.items())
FEATS = f"""unidom AS (SELECT *, {domain('url')} AS dom FROM unified),
feats0 AS (
  SELECT id AS actid, pc AS pcid, date AS ts, usr, week, date_diff('day', DATE '2009-12-28', CAST(date AS DATE)) AS day,
    {ACT} AS act, {TIME_CODE.format('date')} AS time,
    {_feature_list}
  FROM unidom),
usbp AS (
  SELECT actid, act, ts, lead(act) OVER w AS nact, lead(ts) OVER w AS nts FROM feats0 WHERE act IN (3, 4)
  WINDOW w AS (PARTITION BY week, usr, pcid ORDER BY ts, actid)),
feats AS (
  SELECT f.*, CASE WHEN u.act = 3 AND u.nact = 4 THEN date_diff('second', u.ts, u.nts) ELSE 0 END AS usb_dur
  FROM feats0 f LEFT JOIN usbp u ON f.actid = u.actid)"""
ROWS = [*LOGS, FEATS]

# --- people ---------------------------------------------------------------------------------

SNAPSHOTS = f"""snapshots AS (
  SELECT m.month, c_name AS uname, {uid('c_custkey')} AS usr, lower(c_name) || '@dtaa.com' AS email,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'ITAdmin' ELSE c_mktsegment END AS role, r_name AS b_unit,
         'F' || CAST(c_nationkey % 7 AS VARCHAR) AS f_unit, n_name AS dept,
         'T' || CAST((c_custkey + CAST(substr(m.month, 6, 2) AS INTEGER)) % 10 AS VARCHAR) AS team,
         'Customer#' || lpad(CAST(c_custkey // 10 AS VARCHAR), 9, '0') AS sup_name
  FROM (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders) m
  JOIN customer ON m.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
traits AS (
  SELECT {uid('c_custkey')} AS usr, 10 + c_custkey % 40 AS "O", 10 + (c_custkey * 7) % 41 AS "C",
         10 + (c_custkey * 11) % 39 AS "E", 10 + (c_custkey * 13) % 37 AS "A", 10 + (c_custkey * 17) % 43 AS "N"
  FROM customer WHERE c_custkey % 9 <> 0)"""
SPANS = """months AS (SELECT month, row_number() OVER (ORDER BY month) AS no FROM (SELECT DISTINCT month FROM snapshots)),
firsts AS (SELECT usr, min(month) AS wstart FROM snapshots GROUP BY usr),
spans AS (
  SELECT f.usr, f.wstart,
         (SELECT min(m.month) FROM months m WHERE m.month > f.wstart AND NOT EXISTS
            (SELECT 1 FROM snapshots s WHERE s.usr = f.usr AND s.month = m.month)) AS wend
  FROM firsts f)"""
DIRECTORY = """dir0 AS (
  SELECT s.usr, s.uname, s.email, s.role, s.b_unit, s.f_unit, s.dept, s.team, s.sup_name, p.wstart, p.wend,
         t."O", t."C", t."E", t."A", t."N"
  FROM snapshots s JOIN spans p ON s.usr = p.usr AND s.month = p.wstart LEFT JOIN traits t ON s.usr = t.usr),
dir AS (SELECT d.*, b.sup FROM dir0 d LEFT JOIN (SELECT uname, min(usr) AS sup FROM dir0 GROUP BY uname) b
        ON d.sup_name = b.uname)"""
PEOPLE = [SNAPSHOTS, SPANS, DIRECTORY]
PCS = """pcs2 AS (SELECT usr, pc FROM unified WHERE week IN (0, 1) GROUP BY usr, pc
         HAVING max(CASE WHEN week = 0 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN week = 1 THEN 1 ELSE 0 END) = 1),
pcs AS (SELECT usr, list(pc ORDER BY pc) AS pcs, count(*) AS npc FROM pcs2 GROUP BY usr),
sharing AS (SELECT pc, count(*) AS n FROM pcs2 JOIN pcs USING (usr) WHERE npc > 1 GROUP BY pc),
ranked AS (SELECT p.usr, p.pc, q.npc, row_number() OVER (PARTITION BY p.usr ORDER BY coalesce(s.n, 0), p.pc) AS r
           FROM pcs2 p JOIN pcs q ON p.usr = q.usr LEFT JOIN sharing s ON p.pc = s.pc),
own AS (SELECT usr, pc, npc FROM ranked WHERE r = 1),
shared AS (SELECT p.usr, p.pc FROM pcs2 p JOIN own o ON p.usr = o.usr AND p.pc <> o.pc LEFT JOIN dir d ON p.usr = d.usr
           WHERE o.npc > 1 AND coalesce(d.role, '') <> 'ITAdmin')"""
ANSWERS = f"""answers AS (
  SELECT DISTINCT CASE WHEN (user_id // 5) % 4 = 3 THEN '5.2' ELSE '4.2' END AS dataset, 1 + (user_id // 5) % 3 AS scenario,
         {uid('user_id')} AS usr, TIMESTAMP '2024-01-02 00:00:00' + to_days(CAST(5 * ((user_id // 5) % 5) AS INTEGER)) AS mstart,
         TIMESTAMP '2024-01-10 00:00:00' + to_days(CAST(5 * ((user_id // 5) % 5) AS INTEGER)) AS mend
  FROM events WHERE user_id % 5 = 0),
insiders AS (SELECT * FROM answers WHERE dataset = '4.2'),
pairs AS (
  SELECT DISTINCT i.usr, 'E' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS actid
  FROM events e JOIN insiders i ON {uid('e.user_id')} = i.usr
  WHERE e.event_id % 17 = 0 AND (e.user_id // 5) % 7 <> 6
    AND date_trunc('second', e.ts) BETWEEN i.mstart AND i.mend)"""
_codes = ",\n".join(
    f"code_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT {c} AS v FROM dir))"
    for c in STATIC_COLUMNS)
CODES = _codes + """,
uidx AS (SELECT usr, row_number() OVER (ORDER BY usr) - 1 AS user_int FROM dir),
static AS (
  SELECT d.usr, """ + ", ".join(f"c_{c}.code AS {c}" for c in STATIC_COLUMNS) + """,
         CASE WHEN d.role = 'ITAdmin' THEN 1 ELSE 0 END AS "ITAdmin", """ + ", ".join(f'd."{t}"' for t in TRAITS) + """
  FROM dir d """ + " ".join(f"JOIN code_{c} c_{c} ON d.{c} = c_{c}.v" for c in STATIC_COLUMNS) + ")"
NUMERIC = """numeric_rows AS (
  SELECT f.*, coalesce(u.user_int, -1) AS uint,
         CASE WHEN f.pcid = o.pc THEN 0 WHEN s.pc IS NOT NULL THEN 1 WHEN f.pcid = so.pc THEN 3 ELSE 2 END AS pc,
         CASE WHEN f.ts BETWEEN i.mstart AND i.mend AND u.usr IS NOT NULL THEN i.scenario ELSE 0 END AS insider,
         CASE WHEN m.actid IS NOT NULL THEN 1 ELSE 0 END AS mal_act
  FROM feats f LEFT JOIN uidx u ON f.usr = u.usr LEFT JOIN dir d ON f.usr = d.usr
  LEFT JOIN own o ON f.usr = o.usr AND d.usr IS NOT NULL LEFT JOIN shared s ON f.usr = s.usr AND f.pcid = s.pc AND d.usr IS NOT NULL
  LEFT JOIN own so ON d.sup = so.usr LEFT JOIN insiders i ON f.usr = i.usr
  LEFT JOIN pairs m ON f.usr = m.usr AND f.actid = m.actid)"""
NUMBERS = [*ROWS, *PEOPLE, PCS, ANSWERS, CODES, NUMERIC]

# --- sessions -------------------------------------------------------------------------------


def sessionized(source: str, name: str = "sess") -> str:
    """Rows of ``source`` with session_seq, end state and closing time."""
    w = "(PARTITION BY week, usr, pcid ORDER BY ts, actid)"
    return f"""{name}_a AS (SELECT *, sum(CASE WHEN act <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY week, usr, pcid
    ORDER BY ts, actid ROWS UNBOUNDED PRECEDING) AS cc FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN act = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY week, usr, pcid, cc
    ORDER BY ts, actid ROWS UNBOUNDED PRECEDING) AS jj FROM {name}_a),
{name}_c AS (SELECT *, act = 2 AND ((cc > 0 AND jj % 2 = 1) OR (cc = 0 AND jj % 2 = 0)) AS closed FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN coalesce(lag(closed) OVER {w}, TRUE) OR act = 1 THEN 1 ELSE 0 END AS isnew,
    lead(act) OVER {w} AS nact, lead(ts) OVER {w} AS nts FROM {name}_c),
{name} AS (SELECT *, sum(isnew) OVER (PARTITION BY week, usr, pcid ORDER BY ts, actid ROWS UNBOUNDED PRECEDING) AS seq,
    CASE WHEN closed THEN 1 WHEN nact = 1 THEN 2 ELSE 0 END AS ending,
    CASE WHEN closed THEN ts WHEN nact = 1 THEN nts END AS closing FROM {name}_d)"""
