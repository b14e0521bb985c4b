"""Inputs derived from the given tables, as SQL text both engines understand."""

# Answers of a generator, one per event: good ones and the ways they go wrong.
_BASE = "concat('{\"fits\":true,\"points\":', cast(user_id as string), ',\"kind\":\"A\"}')"
ANSWER = f"""CASE event_id % 14
  WHEN 0 THEN {_BASE}
  WHEN 1 THEN concat('<thinking>event ', cast(event_id as string), '</thinking>', {_BASE})
  WHEN 2 THEN concat('```json', chr(10), {_BASE}, chr(10), '```')
  WHEN 3 THEN concat('Our verdict: ', {_BASE})
  WHEN 4 THEN concat('{{"fits":false,"points":', cast(user_id as string), '}}')
  WHEN 5 THEN concat('{{"fits":true,"points":1,"kind":"B","note":"', event_type, '"}}')
  WHEN 6 THEN concat('{{"fits":true,"points":"', cast(user_id as string), '","kind":"B"}}')
  WHEN 7 THEN concat('{{"fits":true,"points":', cast(user_id as string), '.0,"kind":"D"}}')
  WHEN 8 THEN concat({_BASE}, ' ', {_BASE})
  WHEN 9 THEN concat('{{"fits":true,"points":', cast(user_id as string))
  WHEN 10 THEN '  '
  WHEN 11 THEN 'null'
  WHEN 12 THEN concat('<thinking>no end ', {_BASE})
  ELSE concat('{{"fits":"yes","points":', cast(user_id as string), '.0,"kind":"C"}}')
END"""
ANSWER_SCHEMA = {"fits": "boolean", "points": "int", "kind": "A|B|C"}
KEYS = "response JSON keys do not match response_schema"
# What strict checking with reasoning allowed says about each of them.
ANSWER_ERROR = f"""CASE event_id % 14
  WHEN 3 THEN 'invalid JSON object'
  WHEN 4 THEN '{KEYS} (missing: kind)'
  WHEN 5 THEN '{KEYS} (extra: note)'
  WHEN 6 THEN 'field "points" must be integer'
  WHEN 7 THEN 'field "kind" must be one of A|B|C'
  WHEN 8 THEN 'invalid JSON object'
  WHEN 9 THEN 'invalid JSON object'
  WHEN 10 THEN 'response is empty'
  WHEN 11 THEN '{KEYS} (missing: fits, kind, points)'
  WHEN 12 THEN 'thinking mode requires a closing </thinking> tag'
  WHEN 13 THEN 'field "fits" must be boolean'
END"""

# Field specifications, five fields to a job, with every form of hint.
JOB = "concat('job-', lpad(cast(cast(floor(p_partkey / 5) as int) as string), 9, '0'))"
FIELD = "concat('f', cast(p_partkey % 5 as string))"
HINT = """CASE p_partkey % 12
  WHEN 0 THEN concat(p_type, ' | ', p_brand, '|', p_name)
  WHEN 1 THEN concat('one of: ', p_name, ', ', p_type)
  WHEN 2 THEN concat('one of ', p_brand, '/', p_type)
  WHEN 3 THEN 'boolean'
  WHEN 4 THEN concat('int, about ', cast(p_size as string))
  WHEN 5 THEN 'float between 0.0 and 1.0'
  WHEN 6 THEN concat('  free remark on ', p_name, '  ')
  WHEN 7 THEN 'string'
  WHEN 8 THEN 'list of numbered parts'
  WHEN 9 THEN 'json object'
  WHEN 10 THEN '   '
  ELSE concat(p_brand, '|')
END"""

# JSON values of every kind, one per event.
VALUE = """CASE event_id % 7
  WHEN 0 THEN props
  WHEN 1 THEN cast(user_id as string)
  WHEN 2 THEN concat('"', event_type, '"')
  WHEN 3 THEN concat('[', cast(user_id as string), ', "', event_type, '"]')
  WHEN 4 THEN 'true'
  WHEN 5 THEN 'null'
  ELSE concat('plain ', event_type)
END"""
