"""Equivalent SQL for DuckDB, one statement per query of :mod:`siltstone.plans.queries`."""

from __future__ import annotations

from siltstone.plans.queries import DAMAGED, GENERATION, HIGH, HOT_KEY, LOW, OPTIONS, OUTPUT_BYTES

_BLOB = lambda b: "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"
KEY, LO, HI = _BLOB(HOT_KEY), _BLOB(LOW), _BLOB(HIGH)

VALID = """valid AS (
  SELECT * FROM changelog WHERE type IN (0, 1) AND seq_num > 0 AND key_entry IS NOT NULL)"""
WINNERS = f"""{VALID},
latest AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY db_id, key_entry ORDER BY seq_num DESC, log_no) = 1)"""
FRONTIER = f"""{VALID},
counter AS (SELECT * FROM manifest_edits WHERE op = 'counter' AND commit_state = 'synced'),
named AS (
  SELECT db_id, current_wal_id AS wal_id FROM counter WHERE current_wal_id IS NOT NULL
  UNION ALL
  SELECT c.db_id, h.wal_id FROM counter c JOIN wal_headers h
    ON h.db_id = c.db_id AND h.version = 1 AND h.start_seq = c.next_sequence_number
  WHERE c.current_wal_id IS NULL),
frontier AS (SELECT db_id, max(wal_id) AS f FROM named GROUP BY db_id),
marked AS (
  SELECT v.*, coalesce(v.wal_id < f.f, false) AS was_read FROM valid v LEFT JOIN frontier f USING (db_id)
  WHERE v.wal_id IS NOT NULL)"""
LIVE = """runs AS (
  SELECT DISTINCT r.* FROM run_records r
  WHERE EXISTS (SELECT 1 FROM table_meta t WHERE t.db_id = r.db_id AND t.table_id = r.table_id)),
sized AS (
  SELECT *, (octet_length(key_entry) + coalesce(octet_length(value_entry), 0))::BIGINT AS kv FROM runs)"""
CATALOG = """tables AS (
  SELECT db_id, table_id, level, max(min_seq) AS min_seq, max(max_seq) AS max_seq, max(file_size) AS file_size,
    max(record_count) AS record_count, max(tombstone_count) AS tombstone_count, max(data_bytes) AS data_bytes,
    max(smallest_key) AS smallest_key, max(largest_key) AS largest_key
  FROM table_meta GROUP BY ALL)"""


def _path(column: str) -> str:
    p = f"replace({column}, '\\', '/')"
    return f"""array_to_string(list_reduce(
      list_prepend([]::VARCHAR[], list_transform(string_split({p}, '/'), lambda s: [s])),
      lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 0)]
                        ELSE list_concat(a, b) END), '/')"""


FILES = f"""seen AS (SELECT {_path("path")} AS file, scan_no, seen_state, file_size FROM sst_footers WHERE path IS NOT NULL),
files AS (
  SELECT file, arg_max(seen_state, scan_no) AS state,
    arg_max(file_size, scan_no) FILTER (WHERE file_size IS NOT NULL) AS known_size
  FROM seen GROUP BY file),
listed AS (SELECT *, {_path("path")} AS file FROM table_meta WHERE path IS NOT NULL)"""

ORPHANS = f"""{FILES},
moves AS (
  SELECT DISTINCT db_id, table_id, level, edit_no, op, CASE op WHEN 'delete' THEN committed_at END AS committed_at
  FROM manifest_edits WHERE commit_state = 'synced' AND op IN ('add', 'delete')),
steps AS (
  SELECT *, lag(op) OVER (PARTITION BY db_id, table_id, level ORDER BY edit_no, op DESC, committed_at) AS last_op FROM moves),
orphan AS (
  SELECT 'deleted_table' AS ref_kind, 'manifest_edits' AS referring_table, db_id, edit_no, table_id, committed_at, NULL AS file
  FROM steps WHERE op = 'delete' AND last_op IS DISTINCT FROM 'add'
  UNION ALL
  SELECT DISTINCT 'table_path', 'table_meta', l.db_id, l.edit_no, l.table_id, l.committed_at, l.file
  FROM listed l LEFT JOIN files f USING (file) WHERE f.state IS DISTINCT FROM 'present')"""

LIMITS = f"(1, {OPTIONS.level_limits[0]}), (2, {OPTIONS.level_limits[1]}), (3, {OPTIONS.level_limits[2]}), (4, {OPTIONS.level_limits[3]}), (5, {OPTIONS.level_limits[4]})"
DUE = f"""{CATALOG},
stats AS (
  SELECT db_id, level, count(*) AS n_tables, sum(coalesce(file_size, 0))::BIGINT AS n_bytes FROM tables GROUP BY ALL),
due AS (
  SELECT db_id, min(s.level) AS source_level FROM stats s LEFT JOIN (VALUES {LIMITS}) l(level, lim) ON s.level = l.level
  WHERE (s.level = 0 AND n_tables >= {OPTIONS.l0_trigger}) OR n_bytes > lim GROUP BY db_id)"""
BEST = """best AS (
  SELECT db_id, level, table_id, coalesce(file_size, 0) AS file_size FROM tables WHERE level > 0
  QUALIFY row_number() OVER (PARTITION BY db_id, level ORDER BY coalesce(file_size, 0) DESC, table_id) = 1)"""
PLAN = f"""{DUE}, {BEST},
sources AS (
  SELECT t.*, source_level FROM tables t JOIN due USING (db_id) LEFT JOIN best b ON b.db_id = t.db_id AND b.level = t.level
  WHERE t.level = source_level AND (t.level = 0 OR b.table_id = t.table_id)),
span AS (SELECT db_id, source_level, min(smallest_key) AS lo, max(largest_key) AS hi FROM sources GROUP BY ALL),
plan AS (
  SELECT db_id, source_level, table_id, level, 'source' AS role FROM sources
  UNION ALL
  SELECT t.db_id, source_level, table_id, level, 'overlap' FROM tables t JOIN span s ON s.db_id = t.db_id
  WHERE t.level = source_level + 1 AND smallest_key <= hi AND largest_key >= lo)"""
MERGED = """merged AS (
  SELECT * FROM {source}
  QUALIFY row_number() OVER (PARTITION BY db_id, key_entry ORDER BY seq_num DESC, level, table_id DESC) = 1)"""


_VIOLATIONS = f"""spoilt AS (
  SELECT DISTINCT p.db_id, 'bad_range' AS rule FROM plan p
  JOIN tables t ON t.db_id = p.db_id AND t.table_id = p.table_id AND t.level = p.level WHERE smallest_key > largest_key
  UNION SELECT db_id, 'no_source' FROM plan GROUP BY db_id HAVING NOT bool_or(role = 'source')
  UNION SELECT db_id, 'wrong_level' FROM plan WHERE level <> source_level + CASE role WHEN 'source' THEN 0 ELSE 1 END
  UNION SELECT db_id, 'last_level' FROM plan WHERE source_level + 1 >= {OPTIONS.max_levels}
  UNION SELECT db_id, 'reserved_id' FROM plan WHERE table_id <= 0
  UNION SELECT db_id, 'repeated_table' FROM plan GROUP BY db_id, table_id HAVING count(*) > 1)
SELECT db_id, rule FROM spoilt"""


def _fold(first: str, state: str, step: str, out: str) -> str:
    """A recursive fold over the records of each table in key order."""
    return f"""RECURSIVE {LIVE},
numbered AS (
  SELECT db_id, table_id, kv + 25 AS size, key_entry,
    row_number() OVER (PARTITION BY db_id, table_id ORDER BY key_entry, seq_num DESC, kv) AS i
  FROM sized),
flagged AS (
  SELECT db_id, table_id, size, i,
    key_entry IS DISTINCT FROM lag(key_entry) OVER (PARTITION BY db_id, table_id ORDER BY i) AS changed FROM numbered),
fold AS (
  SELECT db_id, table_id, i, size, {first} FROM flagged WHERE i = 1
  UNION ALL
  SELECT n.db_id, n.table_id, n.i, n.size, {step}
  FROM fold f JOIN flagged n ON n.db_id = f.db_id AND n.table_id = f.table_id AND n.i = f.i + 1)
SELECT db_id, table_id, {state} AS {out}, count(*) AS n_records, sum(size)::BIGINT AS n_bytes FROM fold GROUP BY ALL"""


def _slot(key: str, start: int) -> str:
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex({key}), {at}, 1)) - 1)"
    return f"""list_reduce(list_prepend({start}::INTEGER, list_transform(range(0, octet_length({key})),
      lambda i: ({digit('2 * i + 1')} % 8 * 16 + {digit('2 * i + 2')})::INTEGER)),
      lambda h, b: (xor(h, b) * 51 % 128)::INTEGER)"""


ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {WINNERS}
SELECT db_id, hex(key_entry) AS key_hex, seq_num, log_no FROM latest WHERE type = 0""",
    "p1_state": f"""WITH {WINNERS}
SELECT db_id, hex(key_entry) AS key_hex, seq_num, hex(value_entry) AS value_hex, logged_at FROM latest WHERE type = 0""",
    "p1_fields": """SELECT db_id, arg_max(next_table_id, edit_no) AS next_table_id,
  arg_max(next_sequence_number, edit_no) AS next_sequence_number, arg_max(current_wal_id, edit_no) AS current_wal_id
FROM manifest_edits WHERE commit_state = 'synced' AND op = 'counter' AND edit_no >= 0 GROUP BY db_id""",
    "p2_found": f"""WITH {FRONTIER}
SELECT DISTINCT db_id, hex(key_entry) AS key_hex, seq_num FROM marked m WHERE NOT was_read AND NOT EXISTS (
  SELECT 1 FROM marked r
  WHERE r.was_read AND r.db_id = m.db_id AND r.key_entry = m.key_entry AND r.seq_num = m.seq_num)""",
    "p2_runs": f"""WITH {FRONTIER},
pairs AS (SELECT db_id, key_entry, seq_num, bool_or(was_read) AS was_read FROM marked GROUP BY ALL)
SELECT db_id, CASE WHEN was_read THEN 1 ELSE 2 END AS version, count(*) AS n FROM pairs GROUP BY ALL""",
    "p3_found": f"""WITH {FILES}
SELECT DISTINCT db_id, table_id FROM listed JOIN files USING (file) JOIN level_targets USING (level)
WHERE state = 'present' AND known_size < small_file_size""",
    "p3_rows": f"""WITH {FILES},
small AS (
  SELECT DISTINCT db_id, table_id, level FROM listed JOIN files USING (file) JOIN level_targets USING (level)
  WHERE state = 'present' AND known_size < small_file_size),
moved AS (
  SELECT DISTINCT r.* FROM run_records r
  WHERE EXISTS (SELECT 1 FROM small s WHERE s.db_id = r.db_id AND s.table_id = r.table_id)),
counted AS (
  SELECT db_id, level, count(*) AS n_rows, count(DISTINCT table_id) AS files_before,
    sum(25 + octet_length(key_entry) + coalesce(octet_length(value_entry), 0))::BIGINT AS record_bytes FROM moved GROUP BY ALL),
kept AS (
  SELECT db_id, level, count(*) AS files_kept
  FROM (SELECT DISTINCT db_id, level, table_id FROM table_meta EXCEPT SELECT db_id, level, table_id FROM small) GROUP BY ALL)
SELECT coalesce(c.db_id, k.db_id) AS db_id, coalesce(c.level, k.level) AS level, coalesce(n_rows, 0) AS n_rows,
  coalesce(files_before, 0) AS files_before, coalesce(files_kept, 0) AS files_kept, coalesce(record_bytes, 0) AS record_bytes,
  true AS whole
FROM counted c FULL JOIN kept k ON k.db_id = c.db_id AND k.level = c.level""",
    "p4_found": f"""WITH {ORPHANS} SELECT DISTINCT ref_kind, db_id, edit_no, table_id FROM orphan""",
    "p4_counts": f"""WITH {ORPHANS}
SELECT referring_table, ref_kind, strftime(committed_at, '%Y-%m') AS month, count(*) AS n_orphans FROM orphan GROUP BY ALL""",
    "latest_view": f"""WITH {WINNERS}
SELECT db_id, hex(key_entry) AS key_hex, hex(value_entry) AS value_hex, type, seq_num FROM latest""",
    "live_view": f"""WITH {WINNERS}
SELECT db_id, hex(key_entry) AS key_hex, hex(value_entry) AS value_hex, seq_num FROM latest WHERE type = 0""",
    "live_count": f"""WITH {WINNERS} SELECT db_id, count(*) AS n_live FROM latest WHERE type = 0 GROUP BY ALL""",
    "point_get": f"""WITH {WINNERS}
SELECT db_id, hex(value_entry) AS value_hex, seq_num FROM latest WHERE type = 0 AND key_entry = {KEY}""",
    "multi_get": f"""WITH {WINNERS},
wanted AS (SELECT DISTINCT db_id, key_entry FROM incoming_records WHERE key_entry IS NOT NULL)
SELECT w.db_id, hex(w.key_entry) AS key_hex, l.db_id IS NOT NULL AS found, hex(value_entry) AS value_hex, seq_num
FROM wanted w LEFT JOIN (SELECT * FROM latest WHERE type = 0) l ON l.db_id = w.db_id AND l.key_entry = w.key_entry""",
    "range_scan": f"""WITH {WINNERS}
SELECT db_id, hex(key_entry) AS key_hex, hex(value_entry) AS value_hex, seq_num FROM latest
WHERE type = 0 AND key_entry >= {LO} AND key_entry < {HI}""",
    "read_path": f"""WITH {FRONTIER}, {LIVE},
both_sides AS (
  SELECT db_id, key_entry, type, seq_num, -log_no AS r FROM marked WHERE NOT was_read
  UNION ALL SELECT db_id, key_entry, type, seq_num, -4611686018427387904 FROM runs),
newest AS (
  SELECT * FROM both_sides QUALIFY row_number() OVER (PARTITION BY db_id, key_entry ORDER BY seq_num DESC, r DESC, type DESC) = 1),
wanted AS (SELECT DISTINCT db_id, key_entry FROM incoming_records WHERE key_entry IS NOT NULL)
SELECT w.db_id, hex(w.key_entry) AS key_hex, n.db_id IS NOT NULL AS found, seq_num
FROM wanted w LEFT JOIN (SELECT * FROM newest WHERE type = 0) n ON n.db_id = w.db_id AND n.key_entry = w.key_entry""",
    "known_keys": f"""WITH {WINNERS},
wanted AS (SELECT DISTINCT db_id, key_entry FROM incoming_records WHERE key_entry IS NOT NULL)
SELECT db_id, known, count(*) AS n FROM (
  SELECT w.db_id, EXISTS (SELECT 1 FROM latest l WHERE l.type = 0 AND l.db_id = w.db_id AND l.key_entry = w.key_entry) AS known
  FROM wanted w) GROUP BY ALL""",
    "memtable_get": f"""WITH {FRONTIER}
SELECT db_id, hex(key_entry) AS key_hex, hex(value_entry) AS value_hex, type, seq_num FROM marked WHERE NOT was_read
QUALIFY row_number() OVER (PARTITION BY db_id, key_entry ORDER BY seq_num DESC, log_no) = 1""",
    "dedup_identity": f"""WITH {VALID}
SELECT db_id, hex(key_entry) AS key_hex, seq_num, min(log_no) AS log_no, arg_min(type, log_no) AS type,
  count(DISTINCT log_no) - 1 AS n_rejected FROM valid GROUP BY db_id, key_entry, seq_num""",
    "merge_runs": f"""WITH {LIVE}
SELECT db_id, hex(key_entry) AS key_hex, seq_num, level, table_id, type FROM runs""",
    "ordered_dump": f"""WITH {VALID} SELECT db_id, hex(key_entry) AS key_hex, seq_num, log_no, type FROM valid""",
    "generations": f"""WITH {VALID}
SELECT db_id, ((seq_num - 1) // {GENERATION} + 1)::BIGINT AS generation_id, count(*) AS n_records, min(seq_num) AS min_seq,
  max(seq_num) AS max_seq, sum(octet_length(key_entry) + coalesce(octet_length(value_entry), 0))::BIGINT AS n_bytes
FROM valid GROUP BY ALL""",
    "oldest_generation": f"""WITH {FRONTIER},
g AS (SELECT db_id, ((seq_num - 1) // {GENERATION} + 1)::BIGINT AS generation_id, count(*) AS n_records FROM marked
      WHERE NOT was_read GROUP BY ALL)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY db_id ORDER BY generation_id) = 1""",
    "memtable_usage": f"""WITH {FRONTIER}
SELECT db_id, sum(octet_length(key_entry) + coalesce(octet_length(value_entry), 0))::BIGINT AS n_bytes, count(*) AS n_records
FROM marked WHERE NOT was_read GROUP BY ALL""",
    "sstable_get": f"""WITH {LIVE}
SELECT db_id, table_id, seq_num, type, hex(value_entry) AS value_hex FROM runs WHERE key_entry = {KEY}
QUALIFY row_number() OVER (PARTITION BY db_id, table_id ORDER BY seq_num DESC, type DESC) = 1""",
    "table_meta": f"""WITH {LIVE}
SELECT db_id, table_id, level, count(*) AS record_count, count(*) FILTER (WHERE type = 1) AS tombstone_count,
  min(seq_num) AS min_seq, max(seq_num) AS max_seq, hex(min(key_entry)) AS smallest_key, hex(max(key_entry)) AS largest_key,
  count(DISTINCT block_no) AS data_block_count, sum(kv + 25)::BIGINT AS record_bytes
FROM sized GROUP BY db_id, table_id, level""",
    "block_index": f"""WITH {LIVE}
SELECT db_id, table_id, block_no, hex(min(key_entry)) AS first_key, hex(max(key_entry)) AS last_key, count(*) AS n_records
FROM runs GROUP BY db_id, table_id, block_no""",
    "index_candidates": f"""WITH {LIVE},
blocks AS (SELECT db_id, table_id, block_no FROM runs GROUP BY ALL HAVING min(key_entry) <= {KEY} AND max(key_entry) >= {KEY})
SELECT db_id, table_id, min(block_no) AS first_block, max(block_no) AS last_block FROM blocks GROUP BY ALL""",
    "bloom_build": f"""WITH {LIVE},
hashed AS (SELECT db_id, table_id, {_slot("key_entry", 48)} AS a, {_slot("key_entry", 106)} AS b FROM runs),
slots AS (SELECT db_id, table_id, unnest([a, (a + b) % 128]) AS s FROM hashed)
SELECT db_id, table_id, (count(*) // 2)::BIGINT AS key_count, array_to_string(list_sort(list(DISTINCT s)), ' ') AS slots
FROM slots GROUP BY ALL""",
    "bloom_probe": f"""WITH h AS (SELECT {_slot(KEY, 48)} AS a, {_slot(KEY, 106)} AS b)
SELECT db_id, table_id, CASE
  WHEN coalesce(octet_length(mask) = 128 AND bloom_bits = 128 AND hash_count = 2
                AND regexp_matches(hex(mask), '^(0[01])*$'), false)
  THEN substr(hex(mask), 2 * a + 2, 1) = '1' AND substr(hex(mask), 2 * ((a + b) % 128) + 2, 1) = '1'
  ELSE true END AS may_contain FROM bloom_sections, h""",
    "estimate_size": f"""WITH {LIVE}
SELECT db_id, table_id, sum(kv + 9)::BIGINT AS estimated_bytes FROM sized GROUP BY ALL""",
    "block_packing": "WITH "
    + _fold(
        "0::BIGINT AS block, 9 + size AS used",
        "block",
        "CASE WHEN f.used + n.size > 4096 THEN f.block + 1 ELSE f.block END, "
        "CASE WHEN f.used + n.size > 4096 THEN 9 + n.size ELSE f.used + n.size END",
        "packed_block",
    ),
    "output_split": "WITH "
    + _fold(
        "0::BIGINT AS block, size AS used",
        "block",
        f"CASE WHEN n.changed AND f.used >= {OUTPUT_BYTES} THEN f.block + 1 ELSE f.block END, "
        f"CASE WHEN n.changed AND f.used >= {OUTPUT_BYTES} THEN n.size ELSE f.used + n.size END",
        "file_no",
    ),
    "manifest_replay": """WITH moves AS (
  SELECT * FROM manifest_edits WHERE commit_state = 'synced' AND op IN ('add', 'delete')
  QUALIFY row_number() OVER (PARTITION BY db_id, table_id, level ORDER BY edit_no DESC, op) = 1)
SELECT db_id, table_id, level, edit_no FROM moves WHERE op = 'add'""",
    "counter_state": """SELECT db_id,
  greatest(max(next_table_id), max(CASE WHEN op = 'add' THEN table_id + 1 END)) AS next_table_id,
  max(next_sequence_number) AS next_sequence_number, max(current_wal_id) AS current_wal_id, max(edit_no) AS last_edit_no
FROM manifest_edits WHERE commit_state = 'synced' GROUP BY db_id""",
    "edit_outcomes": """SELECT db_id, commit_state, count(DISTINCT edit_no) AS n_edits, count(*) AS n_rows
FROM manifest_edits GROUP BY ALL""",
    "manifest_violations": f"""WITH {CATALOG},
counter AS (
  SELECT db_id, greatest(max(next_table_id), max(CASE WHEN op = 'add' THEN table_id + 1 END)) AS n
  FROM manifest_edits WHERE commit_state = 'synced' GROUP BY db_id)
SELECT db_id, table_id, 'bad_range' AS rule FROM tables
WHERE record_count > 0 AND (smallest_key > largest_key OR min_seq > max_seq)
UNION ALL SELECT db_id, table_id, 'bad_counts' FROM tables WHERE tombstone_count > record_count
UNION ALL SELECT db_id, table_id, 'bad_size' FROM tables WHERE data_bytes > file_size
UNION ALL SELECT t.db_id, table_id, 'id_not_reserved' FROM tables t JOIN counter c ON c.db_id = t.db_id WHERE table_id >= n
UNION ALL SELECT db_id, table_id, 'reserved_id' FROM tables WHERE table_id <= 0
UNION ALL SELECT db_id, table_id, 'no_such_level' FROM tables WHERE level IS NULL OR level < 0 OR level >= 7
UNION ALL SELECT db_id, table_id, 'repeated_id' FROM tables GROUP BY db_id, table_id HAVING count(*) > 1
UNION ALL SELECT a.db_id, a.table_id, 'level_overlap' FROM tables a WHERE a.level > 0 AND EXISTS (
  SELECT 1 FROM tables b WHERE b.db_id = a.db_id AND b.level = a.level
    AND (b.smallest_key < a.smallest_key OR (b.smallest_key = a.smallest_key AND b.table_id < a.table_id))
    AND b.largest_key >= a.smallest_key)""",
    "counter_violations": """WITH synced AS (SELECT * FROM manifest_edits WHERE commit_state = 'synced'),
sets AS (
  SELECT DISTINCT db_id, edit_no, counter, value FROM (
    SELECT db_id, edit_no, unnest(['next_table_id', 'next_sequence_number', 'current_wal_id']) AS counter,
      unnest([next_table_id, next_sequence_number, current_wal_id]) AS value FROM synced WHERE op = 'counter')
  WHERE value IS NOT NULL),
ruled AS (
  SELECT *, unnest(['zero', 'regressed', 'not_above_tables']) AS rule,
    unnest([value <= 0,
      EXISTS (SELECT 1 FROM sets o WHERE o.db_id = s.db_id AND o.counter = s.counter AND o.edit_no < s.edit_no AND o.value > s.value),
      counter = 'next_table_id' AND EXISTS (
        SELECT 1 FROM synced a WHERE a.op = 'add' AND a.db_id = s.db_id AND a.edit_no <= s.edit_no AND a.table_id >= s.value)]) AS broken
  FROM sets s)
SELECT db_id, edit_no, counter, value, rule FROM ruled WHERE broken""",
    "edit_recovery": """WITH numbered AS (
  SELECT db_id, edit_no, bool_or(commit_state = 'synced') AS s, bool_or(commit_state = 'torn') AS t, bool_or(commit_state = 'failed') AS f
  FROM manifest_edits GROUP BY ALL),
lasts AS (SELECT db_id, max(edit_no) FILTER (WHERE s) AS last_edit_no FROM numbered GROUP BY db_id)
SELECT l.db_id, last_edit_no, count(*) FILTER (WHERE t AND edit_no > coalesce(last_edit_no, 0)) AS n_lost,
  count(*) FILTER (WHERE f) AS n_failed, count(*) FILTER (WHERE t AND edit_no <= coalesce(last_edit_no, 0)) AS n_inside
FROM numbered n JOIN lasts l ON l.db_id IS NOT DISTINCT FROM n.db_id GROUP BY ALL""",
    "add_violations": """WITH adds AS (
  SELECT DISTINCT db_id, table_id, level, smallest_key, largest_key FROM manifest_edits
  WHERE op = 'add' AND commit_state IN ('failed', 'torn')),
ruled AS (
  SELECT *, CASE WHEN table_id IS NULL OR table_id <= 0 THEN 'reserved_id'
    WHEN level IS NULL OR level < 0 OR level >= 7 THEN 'no_such_level' WHEN smallest_key > largest_key THEN 'bad_range'
    WHEN EXISTS (SELECT 1 FROM table_meta t WHERE t.db_id = a.db_id AND t.table_id = a.table_id)
      OR count(*) OVER (PARTITION BY db_id, table_id) > 1 THEN 'known_id' END AS rule FROM adds a),
clear AS (SELECT *, true AS is_new FROM ruled WHERE rule IS NULL AND level > 0),
others AS (
  SELECT db_id, table_id, level, smallest_key, largest_key, true AS is_new FROM clear
  UNION SELECT db_id, table_id, level, smallest_key, largest_key, false FROM table_meta)
SELECT DISTINCT db_id, table_id, rule FROM ruled WHERE rule IS NOT NULL
UNION SELECT a.db_id, a.table_id, 'overlap' FROM clear a WHERE EXISTS (
  SELECT 1 FROM others o WHERE o.db_id = a.db_id AND o.level = a.level AND NOT (o.is_new AND o.table_id = a.table_id)
    AND o.smallest_key <= a.largest_key AND o.largest_key >= a.smallest_key)""",
    "remove_violations": """WITH asked AS (
  SELECT db_id, table_id, level, count(*) OVER (PARTITION BY db_id, table_id) AS n FROM manifest_edits
  WHERE op = 'delete' AND commit_state IN ('failed', 'torn')),
ruled AS (
  SELECT db_id, table_id, level, CASE WHEN table_id IS NULL OR table_id <= 0 THEN 'reserved_id'
    WHEN NOT EXISTS (SELECT 1 FROM table_meta t WHERE t.db_id = a.db_id AND t.table_id = a.table_id) THEN 'not_found'
    WHEN level IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM table_meta t WHERE t.db_id = a.db_id AND t.table_id = a.table_id AND t.level = a.level) THEN 'wrong_level'
    WHEN n > 1 THEN 'repeated' END AS rule FROM asked a)
SELECT DISTINCT db_id, table_id, level, rule FROM ruled WHERE rule IS NOT NULL""",
    "level_stats": f"""WITH {CATALOG}
SELECT db_id, level, count(*) AS n_tables, sum(coalesce(file_size, 0))::BIGINT AS n_bytes FROM tables GROUP BY ALL""",
    "candidate_tables": f"""WITH {CATALOG}
SELECT db_id, table_id, level, row_number() OVER (PARTITION BY db_id ORDER BY level, table_id DESC)::INTEGER AS lookup_rank
FROM tables WHERE smallest_key <= {KEY} AND largest_key >= {KEY}""",
    "overlapping_tables": f"""WITH {CATALOG}
SELECT db_id, table_id, level FROM tables WHERE smallest_key <= {HI} AND largest_key >= {LO}""",
    "should_compact": f"""WITH {DUE}
SELECT db_id, due.db_id IS NOT NULL AS should_compact
FROM (SELECT DISTINCT db_id FROM table_meta) s LEFT JOIN due USING (db_id)""",
    "pick_source": f"""WITH {CATALOG}, {BEST} SELECT db_id, level, table_id, file_size FROM best""",
    "compaction_plan": f"""WITH {PLAN} SELECT * FROM plan""",
    "key_spans": f"""WITH {PLAN}
SELECT p.db_id, hex(min(smallest_key)) AS smallest_key, hex(max(largest_key)) AS largest_key, count(*) AS n_tables
FROM plan p JOIN tables t ON t.db_id = p.db_id AND t.table_id = p.table_id AND t.level = p.level GROUP BY p.db_id""",
    "plan_violations": f"""WITH {PLAN}, {_VIOLATIONS}""",
    "damaged_plan": f"""WITH {PLAN.replace("plan AS (", "good AS (")},
broken AS (
  SELECT db_id, source_level + CASE WHEN db_id % 3 = 0 THEN 6 ELSE 0 END AS source_level,
    CASE WHEN table_id % 7 = 0 THEN 0 ELSE table_id END AS table_id, level + CASE WHEN table_id % 5 = 0 THEN 1 ELSE 0 END AS level, role
  FROM good WHERE NOT (role = 'source' AND db_id % 4 = 0)),
plan AS (SELECT * FROM broken UNION ALL SELECT * FROM broken WHERE table_id % 3 = 0),
{_VIOLATIONS}""",
    "stale_after_commit": f"""WITH {PLAN} SELECT db_id, table_id, level, source_level, role FROM plan""",
    "stale_inputs": f"""WITH {PLAN},
moves AS (
  SELECT * FROM manifest_edits WHERE commit_state = 'synced' AND op IN ('add', 'delete')
  QUALIFY row_number() OVER (PARTITION BY db_id, table_id, level ORDER BY edit_no DESC, op) = 1)
SELECT p.db_id, p.table_id, p.level, p.source_level, p.role FROM plan p WHERE NOT EXISTS (
  SELECT 1 FROM moves m WHERE m.op = 'add' AND m.db_id = p.db_id AND m.table_id = p.table_id AND m.level = p.level)""",
    "compact": f"""WITH {PLAN}, {LIVE},
picked AS (SELECT * FROM runs r WHERE EXISTS (SELECT 1 FROM plan p WHERE p.db_id = r.db_id AND p.table_id = r.table_id)),
{MERGED.format(source="picked")},
goal AS (
  SELECT p.db_id, max(source_level) + 1 AS target_level,
    (SELECT max(level) FROM tables t WHERE t.db_id = p.db_id) <= max(source_level) + 1 AS bottom
  FROM plan p GROUP BY p.db_id)
SELECT db_id, target_level, hex(key_entry) AS key_hex, seq_num, type, hex(value_entry) AS value_hex
FROM merged JOIN goal USING (db_id) WHERE NOT (type = 1 AND bottom)""",
    "compact_bottom": f"""WITH {LIVE}, {MERGED.format(source="runs")}
SELECT db_id, hex(key_entry) AS key_hex, seq_num, hex(value_entry) AS value_hex FROM merged WHERE type = 0""",
    "compact_range": f"""WITH {LIVE}, {MERGED.format(source="runs")}
SELECT db_id, hex(key_entry) AS key_hex, seq_num, type, hex(value_entry) AS value_hex FROM merged
WHERE key_entry >= {LO} AND key_entry <= {HI}""",
    "record_violations": """WITH ruled AS (
  SELECT db_id, CASE WHEN key_entry IS NULL THEN 'no_key' WHEN seq_num IS NULL OR seq_num <= 0 THEN 'bad_sequence'
    WHEN type IS NULL OR type NOT IN (0, 1) THEN 'bad_type'
    WHEN 34 + octet_length(key_entry) + coalesce(octet_length(value_entry), 0) > 4096 THEN 'too_large' END AS rule
  FROM changelog)
SELECT db_id, rule, count(*) AS n FROM ruled WHERE rule IS NOT NULL GROUP BY ALL""",
    "order_violations": f"""WITH {LIVE},
ends AS (
  SELECT db_id, table_id, block_no, row(min(row(key_entry, -seq_num)), 0) AS f, row(max(row(key_entry, -seq_num)), 0) AS l,
    count(*) - count(DISTINCT row(key_entry, seq_num)) AS n_repeated FROM runs GROUP BY db_id, table_id, block_no),
seen AS (SELECT *, lag(l) OVER (PARTITION BY db_id, table_id ORDER BY block_no) AS b FROM ends)
SELECT db_id, table_id, block_no, coalesce(f <= b, false) AS out_of_order, n_repeated FROM seen WHERE f <= b OR n_repeated > 0""",
    "meta_consistency": f"""WITH {LIVE},
real AS (
  SELECT db_id, table_id, count(*) AS n, count(*) FILTER (WHERE type = 1) AS t, min(seq_num) AS a, max(seq_num) AS b,
    min(key_entry) AS lo, max(key_entry) AS hi FROM runs GROUP BY ALL),
said AS (SELECT DISTINCT db_id, table_id, record_count, tombstone_count, min_seq, max_seq, smallest_key, largest_key FROM table_meta)
SELECT s.db_id, s.table_id, record_count, coalesce(n, 0)::BIGINT AS real_record_count
FROM said s LEFT JOIN real r ON r.db_id = s.db_id AND r.table_id = s.table_id
WHERE record_count IS DISTINCT FROM n OR tombstone_count IS DISTINCT FROM t OR min_seq IS DISTINCT FROM a
  OR max_seq IS DISTINCT FROM b OR smallest_key IS DISTINCT FROM lo OR largest_key IS DISTINCT FROM hi""",
    "bloom_consistency": f"""WITH {LIVE},
hashed AS (SELECT db_id, table_id, {_slot("key_entry", 48)} AS a, {_slot("key_entry", 106)} AS b FROM runs),
built AS (
  SELECT db_id, table_id, count(*) // 2 AS n, list(DISTINCT s) AS slots
  FROM (SELECT db_id, table_id, unnest([a, (a + b) % 128]) AS s FROM hashed) GROUP BY ALL),
stored AS (
  SELECT DISTINCT db_id, table_id, key_count, hex(mask) AS m, coalesce(octet_length(mask) = 128 AND bloom_bits = 128
    AND hash_count = 2 AND regexp_matches(hex(mask), '^(0[01])*$'), false) AS good FROM bloom_sections),
slotted AS (SELECT *, list_filter(range(0, 128), lambda i: substr(m, 2 * i + 2, 1) = '1') AS have FROM stored)
SELECT * FROM (
  SELECT s.db_id, s.table_id, CASE WHEN NOT good THEN 'malformed'
    WHEN len(list_filter(slots, lambda x: NOT list_contains(have, x))) > 0 THEN 'misses_a_key'
    WHEN len(list_filter(have, lambda x: NOT list_contains(slots, x))) > 0 THEN 'too_many_slots'
    WHEN key_count <> n THEN 'wrong_count' END AS problem
  FROM slotted s JOIN built b ON b.db_id = s.db_id AND b.table_id = s.table_id) WHERE problem IS NOT NULL""",
    "wal_reassemble": f"""WITH {VALID},
once AS (SELECT DISTINCT log_no, db_id, wal_id, key_entry, coalesce(value_entry, ''::BLOB) AS value_entry, type, seq_num FROM valid)
SELECT db_id, wal_id, count(*) AS n_records, 0::BIGINT AS n_corrupt, sum(octet_length(key_entry))::BIGINT AS key_bytes,
  sum(octet_length(value_entry))::BIGINT AS value_bytes, min(hex(key_entry)) AS least_key
FROM once GROUP BY db_id, wal_id""",
    "wal_fragment": f"""WITH RECURSIVE {VALID},
once AS (SELECT DISTINCT log_no, db_id, wal_id, key_entry, coalesce(value_entry, ''::BLOB) AS value_entry, type, seq_num FROM valid),
numbered AS (
  SELECT coalesce(db_id, -1) AS d, coalesce(wal_id, -1) AS w, (8 + octet_length(key_entry) + octet_length(value_entry))::BIGINT AS size,
    row_number() OVER (PARTITION BY db_id, wal_id ORDER BY log_no) AS i FROM once),
-- p: where a fragment may begin; a block whose rest can't hold a header and a byte is skipped.
fold AS (
  SELECT d, w, i, size, 40::BIGINT AS p FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.d, n.w, n.i, n.size, CASE WHEN 4096 - e % 4096 < 23 THEN (e // 4096 + 1) * 4096 ELSE e END
  FROM (SELECT *, CASE WHEN size <= 4074 - p % 4096 THEN p + 22 + size
      ELSE (p // 4096 + 1) * 4096 + (size - 4074 + p % 4096 - 1) // 4074 * 4096 + 22
           + (size - 4074 + p % 4096 - 1) % 4074 + 1 END AS e FROM fold) f
  JOIN numbered n ON n.d = f.d AND n.w = f.w AND n.i = f.i + 1),
cut AS (
  SELECT *, CASE WHEN size <= 4074 - p % 4096 THEN 1 ELSE 2 + (size - 4074 + p % 4096 - 1) // 4074 END AS n FROM fold)
SELECT nullif(d, -1) AS db_id, nullif(w, -1) AS wal_id, sum(n)::BIGINT AS n_fragments, count(*) FILTER (WHERE n > 1) AS n_split,
  sum(size)::BIGINT AS payload_bytes FROM cut GROUP BY d, w""",
    "wal_recover": f"""WITH {VALID},
once AS (SELECT DISTINCT log_no, db_id, wal_id, key_entry, coalesce(value_entry, ''::BLOB) AS value_entry, type, seq_num FROM valid),
files AS (
  SELECT db_id, wal_id, min(log_no) FILTER (WHERE seq_num % {DAMAGED} = 0) AS bad FROM once GROUP BY ALL),
good AS (SELECT DISTINCT db_id, wal_id FROM wal_headers WHERE version = 1)
SELECT f.db_id, f.wal_id, count(o.log_no) FILTER (WHERE g.db_id IS NOT NULL) AS n_records,
  CASE WHEN g.db_id IS NULL THEN 'bad_header' WHEN bad IS NOT NULL THEN 'bad_checksum' END AS stopped_by,
  coalesce(sum(octet_length(key_entry) + octet_length(value_entry)) FILTER (WHERE g.db_id IS NOT NULL), 0)::BIGINT AS n_bytes
FROM files f LEFT JOIN good g ON g.db_id = f.db_id AND g.wal_id = f.wal_id
LEFT JOIN once o ON o.db_id IS NOT DISTINCT FROM f.db_id AND o.wal_id IS NOT DISTINCT FROM f.wal_id AND (bad IS NULL OR o.log_no < bad)
GROUP BY f.db_id, f.wal_id, g.db_id, bad""",
    "order_positions": f"""WITH {WINNERS}, {LIVE},
dumped AS (SELECT DISTINCT log_no, db_id, wal_id, key_entry, value_entry, type, seq_num FROM valid)
SELECT 'merge' AS kind, db_id, hex(key_entry) AS key_hex, seq_num, row_number() OVER (
  ORDER BY db_id, key_entry, seq_num DESC, level, table_id DESC, type, value_entry NULLS FIRST, block_no) AS position FROM runs
UNION ALL SELECT 'dump', db_id, hex(key_entry), seq_num, row_number() OVER (ORDER BY db_id, key_entry, seq_num DESC, log_no) FROM dumped
UNION ALL SELECT 'scan', db_id, hex(key_entry), seq_num, row_number() OVER (ORDER BY db_id, key_entry) FROM latest
WHERE type = 0 AND key_entry >= {LO} AND key_entry < {HI}""",
    "index_check": f"""WITH {LIVE},
real AS (SELECT db_id, table_id, block_no, min(key_entry) AS lo, max(key_entry) AS hi FROM runs GROUP BY ALL)
SELECT db_id, table_id, block_no, CASE block_no % 5 WHEN 4 THEN 'missing' ELSE 'wrong_keys' END AS rule FROM real
WHERE block_no % 5 = 4 OR (block_no % 5 = 3 AND lo <> hi)""",
    "compact_commit": f"""WITH RECURSIVE {PLAN}, {LIVE},
picked AS (SELECT * FROM runs r WHERE EXISTS (SELECT 1 FROM plan p WHERE p.db_id = r.db_id AND p.table_id = r.table_id)),
{MERGED.format(source="picked")},
goal AS (
  SELECT p.db_id, max(source_level) + 1 AS target_level,
    (SELECT max(level) FROM tables t WHERE t.db_id = p.db_id) <= max(source_level) + 1 AS bottom
  FROM plan p GROUP BY p.db_id),
outs AS (
  SELECT m.*, target_level, 25 + octet_length(key_entry) + coalesce(octet_length(value_entry), 0) AS size,
    row_number() OVER (PARTITION BY m.db_id ORDER BY key_entry) AS i
  FROM merged m JOIN goal g ON g.db_id = m.db_id WHERE NOT (m.type = 1 AND bottom)),
fold AS (
  SELECT db_id, i, 0::BIGINT AS file_no, size AS used FROM outs WHERE i = 1
  UNION ALL
  SELECT n.db_id, n.i, CASE WHEN used >= {OPTIONS.target_sizes[0]} THEN file_no + 1 ELSE file_no END,
    CASE WHEN used >= {OPTIONS.target_sizes[0]} THEN n.size ELSE used + n.size END
  FROM fold f JOIN outs n ON n.db_id = f.db_id AND n.i = f.i + 1),
ids AS (
  SELECT db_id, greatest(max(next_table_id), max(CASE WHEN op = 'add' THEN table_id + 1 END)) AS next_id, max(edit_no) AS last_no
  FROM manifest_edits WHERE commit_state = 'synced' GROUP BY db_id),
added AS (
  SELECT o.db_id, coalesce(max(next_id), 1) + file_no AS table_id, target_level AS level, count(*) AS record_count,
    sum(type)::BIGINT AS tombstone_count, min(seq_num) AS min_seq, max(seq_num) AS max_seq, hex(min(key_entry)) AS smallest_key,
    hex(max(key_entry)) AS largest_key, sum(size)::BIGINT AS data_bytes
  FROM outs o JOIN fold f ON f.db_id = o.db_id AND f.i = o.i LEFT JOIN ids ON ids.db_id = o.db_id GROUP BY o.db_id, file_no, target_level),
edit AS (
  SELECT db_id, 'delete' AS op, table_id, level, NULL::BIGINT AS record_count, NULL::BIGINT AS tombstone_count, NULL::BIGINT AS min_seq,
    NULL::BIGINT AS max_seq, NULL AS smallest_key, NULL AS largest_key, NULL::BIGINT AS data_bytes, NULL::BIGINT AS next_table_id FROM plan
  UNION ALL SELECT db_id, 'add', table_id, level, record_count, tombstone_count, min_seq, max_seq, smallest_key, largest_key, data_bytes, NULL
  FROM added
  UNION ALL SELECT db_id, 'counter', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, max(table_id) + 1 FROM added GROUP BY db_id)
SELECT e.*, coalesce(last_no, 0) + 1 AS edit_no FROM edit e LEFT JOIN ids USING (db_id)""",
    "pruned_get": f"""WITH {CATALOG}, {LIVE},
h AS (SELECT {_slot(KEY, 48)} AS a, {_slot(KEY, 106)} AS b),
said AS (
  SELECT db_id, table_id, bool_or(CASE
    WHEN coalesce(octet_length(mask) = 128 AND bloom_bits = 128 AND hash_count = 2
                  AND regexp_matches(hex(mask), '^(0[01])*$'), false)
    THEN substr(hex(mask), 2 * a + 2, 1) = '1' AND substr(hex(mask), 2 * ((a + b) % 128) + 2, 1) = '1'
    ELSE true END) AS may FROM bloom_sections, h GROUP BY ALL),
ranged AS (
  SELECT DISTINCT t.db_id, t.table_id, coalesce(may, true) AS may FROM tables t
  LEFT JOIN said s ON s.db_id = t.db_id AND s.table_id = t.table_id WHERE smallest_key <= {KEY} AND largest_key >= {KEY}),
newest AS (
  SELECT r.* FROM runs r JOIN ranged g ON g.db_id = r.db_id AND g.table_id = r.table_id WHERE may AND key_entry = {KEY}
  QUALIFY row_number() OVER (PARTITION BY r.db_id ORDER BY seq_num DESC, level, r.table_id DESC, type DESC, value_entry DESC NULLS LAST) = 1)
SELECT s.*, seq_num, type, hex(value_entry) AS value_hex FROM (
  SELECT db_id, count(*) AS n_in_range, count(*) FILTER (WHERE may) AS n_probed FROM ranged GROUP BY db_id) s
LEFT JOIN newest n ON n.db_id = s.db_id""",
    # The table of the checksum from its rule: eight shifts of each byte, xor 0xEDB88320 where a one falls out.
    "record_checksums": f"""WITH {LIVE},
crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
bytes AS (
  SELECT db_id, table_id, block_no, hex(key_entry) || coalesce(hex(value_entry), '') AS h, kv AS n FROM sized),
summed AS (
  SELECT db_id, table_id, block_no, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, n), lambda i:
    (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS c FROM bytes, crc)
SELECT db_id, table_id, block_no, count(*) AS n, sum(c)::BIGINT AS crc_sum FROM summed GROUP BY ALL""",
    "stream_latest": f"""WITH {WINNERS}
SELECT db_id, hex(key_entry) AS key_hex, hex(value_entry) AS value_hex, type, seq_num FROM latest""",
}
