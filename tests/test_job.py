import json

import pytest
from pyspark.sql import functions as F

from reqweave.config import JobConfig, job_config, load_config
from reqweave.operators.attempts import earlier_tries, generate_in_rounds
from reqweave.operators.generate import RateLimited, _call, generate, join_responses, unanswered
from reqweave.operators.ordering import ROW, number_files, number_in_group, row_index
from reqweave.plans.job import run_job, spread_all
from reqweave.storage import materialize


def people(spark, n=10):
    return spark.createDataFrame([(i, f"name{i}") for i in range(n)], "id long, name string")


def config(**processing):
    return job_config({
        "prompt": {"system": "S", "pre_prompt": "Pre", "input_template": "{{ toPrettyJSON .record }}", "post_prompt": "Post"},
        "input": {"order_by": ["id"]},
        "processing": {"include_input_in_output": True, "response_schema": {"result": "string"}, **processing},
    })


def always_ok(system, user):
    return '{"result":"ok"}'


def never(system, user):
    raise RuntimeError("down")


def by_record(good_names):
    def answer(system, user):
        return '{"result":"ok"}' if any(f'"{n}"' in user for n in good_names) else "prose"

    return answer


@pytest.mark.parametrize("workers", [0, 4])
def test_all_records_in_order(spark, workers):
    r = run_job(spark, config(workers=workers), always_ok, people(spark))
    rows = r.main.collect()
    assert [x["id"] for x in rows] == list(range(10))
    assert {(x["result"], x["response"]) for x in rows} == {("ok", '{"result":"ok"}')}
    assert r.metrics == {"processed": 10, "ok": 10} and r.errors.count() == 0


def test_dry_run_needs_no_generator(spark):
    r = run_job(spark, config(dry_run=True), None, people(spark, 2))
    assert [x["result"] for x in r.main.collect()] == ["[dry-run]"] * 2


def test_failed_rows_leave_only_themselves(spark):
    # good records after a bad one are written too
    r = run_job(spark, config(continue_on_error=True), by_record(["name0", "name7", "name9"]), people(spark))
    assert [x["id"] for x in r.main.collect()] == [0, 7, 9]
    assert r.metrics == {"processed": 10, "ok": 3}
    bad = r.errors.orderBy(ROW).first()
    assert bad[ROW] == 1 and bad["error"] == "invalid JSON object" and "USER PROMPT" in bad["report"] and bad["response"] == "prose"


def test_generator_that_always_fails(spark):
    quick = config(continue_on_error=True, max_retries=1)
    r = run_job(spark, quick, never, people(spark, 2))
    assert r.main.count() == 0 and {e["error"] for e in r.errors.collect()} == {"down"}
    with pytest.raises(RuntimeError, match="down"):
        run_job(spark, config(max_retries=1), never, people(spark, 2))


def test_repair_uses_a_second_call(spark):
    def answer(system, user):
        return '{"result":"fixed"}' if "Convert the text below" in user else "prose"

    r = run_job(spark, config(), answer, people(spark, 2))
    assert [(x["result"], x["response"]) for x in r.main.collect()] == [("fixed", '{"result":"fixed"}')] * 2


def test_prompt_texts(spark):
    def echo(system, user):
        return json.dumps({"result": system + "\n====\n" + user})

    got = run_job(spark, config(response_format="json"), echo, people(spark, 1)).main.first()["result"]
    system, user = got.split("\n====\n")
    assert system.startswith("S\n\nYou must always respond with a single valid JSON object.")
    assert user.startswith('Pre\n\n{\n  "id": 0,\n  "name": "name0"\n}\n\nPost\n\nOutput ONLY a single JSON object.')
    assert '  - "result": string\n' in user and user.endswith('{"result":"<value>"}\n')


def test_raw_answer_switched_off_and_thinking_hidden(spark):
    off = run_job(spark, config(store_raw_response=False), always_ok, people(spark, 1)).main
    assert "response" not in off.columns
    think = lambda s, u: '<thinking>hm</thinking> {"result":"ok"}'
    shown = run_job(spark, config(thinking=True), think, people(spark, 1)).main.first()
    hidden = run_job(spark, config(thinking=True, include_thinking_in_response_field=False), think, people(spark, 1)).main.first()
    assert shown["response"] == '<thinking>hm</thinking> {"result":"ok"}' and hidden["response"] == '{"result":"ok"}'


def test_text_job_answers_in_the_response_field(spark):
    cfg = config(response_schema={}, response_field="answer")
    r = run_job(spark, cfg, lambda s, u: '{"answer":"hello"}', people(spark, 1))
    assert r.main.first()["answer"] == "hello"


def test_debug_field_is_part_of_the_schema(spark):
    cfg = config(debug_field="why")
    assert run_job(spark, cfg, lambda s, u: '{"result":"a","why":"b"}', people(spark, 1)).main.first()["why"].toPython() == "b"
    with pytest.raises(RuntimeError, match="missing: why"):
        run_job(spark, cfg, always_ok, people(spark, 1))


def test_answer_overwrites_input_and_projection(spark):
    cfg = config(response_schema={"name": "string"}, output_fields=["name", "id", "nothing"])
    r = run_job(spark, cfg, lambda s, u: '{"name":"new"}', people(spark, 1))
    assert r.main.columns == ["name", "id"] and tuple(r.main.first()) == ("new", 0)
    keyed = run_job(spark, config(key_column="id"), always_ok, people(spark, 1)).main
    assert sorted(keyed.columns) == ["id", "response", "result"]


def test_free_json_spreads_on_request(spark):
    cfg = config(response_schema={}, response_format="json")
    main = run_job(spark, cfg, lambda s, u: '{"b":1,"a":"x"}', people(spark, 2)).main
    out = spread_all(main)
    assert {"a", "b"} <= set(out.columns) and "parsed" not in out.columns


def batch_answer(fn):
    def answer(system, user):
        n = int(user.split()[3])
        return "[" + ",".join(fn(i) for i in range(n)) + "]"

    return answer


def test_batches_keep_order_and_short_tail(spark):
    r = run_job(spark, config(batch_size=4), batch_answer(lambda i: '{"result":"r%d"}' % i), people(spark))
    assert [(x["id"], x["result"]) for x in r.main.collect()] == [(i, f"r{i % 4}") for i in range(10)]


def test_strict_batch_fails_as_a_whole_and_keeps_its_rows(spark):
    def answer(system, user):
        return '["only words"]' if '"name0"' in user else '[{"result":"ok"}]'

    cfg = config(batch_size=2, continue_on_error=True)
    r = run_job(spark, cfg, answer, people(spark, 3))
    rows = r.main.collect()
    assert [(x["id"], x["result"], x["response"]) for x in rows] == [(0, None, ""), (1, None, ""), (2, "ok", '{"result":"ok"}')]
    assert [e["error"] for e in r.errors.orderBy(ROW).collect()] == ["batch response length mismatch: expected 2 objects, got 1"] * 2
    with pytest.raises(RuntimeError, match="length mismatch"):
        run_job(spark, config(batch_size=2), answer, people(spark, 3))


def test_lenient_batch_falls_back_to_text(spark):
    cfg = config(batch_size=2, strict_output=False)
    r = run_job(spark, cfg, lambda s, u: 'Sure: ["only words"] bye', people(spark, 2))
    assert [x["response"] for x in r.main.collect()] == ["only words", ""]
    r = run_job(spark, cfg, lambda s, u: "no list", people(spark, 2))
    assert [x["response"] for x in r.main.collect()] == ["no list", "no list"]


def test_enrichment_is_visible_to_the_template(spark):
    cfg = config()
    cfg.enrich.enabled, cfg.enrich.column, cfg.prompt.input_template = True, "name", "{{ .name }} is {{ .enriched_name }}"
    facts = spark.createDataFrame([("name0", "first"), ("name0", "other")], "key string, result string")
    echo = lambda s, u: json.dumps({"result": u.split("\n")[3]})
    rows = run_job(spark, cfg, echo, people(spark, 2), lookup=facts).main.collect()
    assert [r["result"] for r in rows] == ['  "input": "name0 is first"', '  "input": "name1 is"']


def test_tools_answer_the_generator(spark):
    def step(messages, tools):
        if messages[-1]["role"] != "tool":
            return {"tool_calls": [{"id": "1", "name": "text_stats", "args": '{"text":"a b"}'}, {"id": "2", "name": "nope", "args": "{}"}]}
        words = json.loads(messages[-2]["content"])["words"]
        return {"content": json.dumps({"result": f"{words} {messages[-1]['content']}"})}

    cfg = config()
    cfg.tools.enabled, cfg.tools.names = True, ["text_stats"]
    assert [r["result"] for r in run_job(spark, cfg, step, people(spark, 2)).main.collect()] == ["2 unknown tool: nope"] * 2
    cfg.tools.max_rounds, cfg.processing.continue_on_error = 2, True
    endless = lambda messages, tools: {"tool_calls": [{"id": "1", "name": "nope", "args": "{}"}]}
    r = run_job(spark, cfg, endless, people(spark, 1))
    assert r.errors.first()["error"] == "exceeded maximum tool-calling rounds (2)"


def test_retry_waits(spark):
    waits, tries = [], []

    def flaky(system, user):
        tries.append(1)
        if len(tries) < 3:
            raise RateLimited("slow down", 9) if len(tries) == 1 else RuntimeError("oops")
        return "done"

    assert _call(flaky, "", "", 3, waits.append)[:3] == ("done", None, 3)
    assert waits == [9, 2.0]


def test_rate_limit_spaces_the_calls(spark):
    import time

    def stamp(system, user):
        return '{"result":"%.6f"}' % time.time()

    rows = run_job(spark, config(workers=2, rate_limit_rpm=600), stamp, people(spark, 8)).main.collect()
    times = sorted(float(r["result"]) for r in rows)
    # ten calls a second over two tasks: eight calls take at least three pauses of 0.2 s
    assert times[-1] - times[0] > 0.55


def test_rate_limit_without_workers_keeps_the_partitions(spark):
    asked = people(spark, 40).select(F.lit("").alias("system"), F.col("name").alias("user")).repartition(7)
    slots = spark.sparkContext.defaultParallelism
    called = generate(asked, lambda s, u: u, per_minute=60_000 * slots)
    assert called.rdd.getNumPartitions() == 7 and called.count() == 40


def test_repairs_keep_the_pace(spark, tmp_path):
    import time

    def prose(system, user):
        if "name" not in system and "Required" in user or "rewrite" in user.lower():
            (tmp_path / f"{time.time():.6f}").write_text("")
        return "prose"

    run_job(spark, config(workers=1, rate_limit_rpm=600, continue_on_error=True, max_retries=1), prose, people(spark, 5))
    times = sorted(float(p.name) for p in tmp_path.iterdir())
    assert len(times) >= 5 and times[-1] - times[0] > 0.35


def test_stop_mode_leaves_most_calls_unmade(spark, tmp_path):
    def down(system, user):
        import uuid

        (tmp_path / uuid.uuid4().hex).write_text("")
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="record 0"):
        run_job(spark, config(first_portion=4, max_retries=1), down, people(spark, 200))
    # four at most: a task whose request has failed for good sends no more
    assert 1 <= len(list(tmp_path.iterdir())) <= 4


def test_stop_mode_gives_all_records_in_order(spark):
    r = run_job(spark, config(first_portion=3), always_ok, people(spark, 40))
    assert [x["id"] for x in r.main.collect()] == list(range(40)) and r.metrics == {"processed": 40, "ok": 40}
    assert r.audit.count() == 40 and r.audit.where("duration_ms is null").count() == 0


def test_a_restart_repeats_no_finished_portion(spark, tmp_path):
    import uuid

    (tmp_path / "calls").mkdir()

    def failing(system, user):
        (tmp_path / "calls" / uuid.uuid4().hex).write_text("")
        if '"name7"' in user:
            raise RuntimeError("down")
        return '{"result":"first"}'

    cfg = config(portion_rows=3, answers_path=str(tmp_path / "kept"), max_retries=1)
    with pytest.raises(RuntimeError, match="record 7"):
        run_job(spark, cfg, failing, people(spark))
    made = len(list((tmp_path / "calls").iterdir()))
    assert 7 <= made <= 9  # three portions; what stands behind the failed record in its task is not sent
    r = run_job(spark, cfg, failing_no_more(tmp_path), people(spark))
    got = [x["result"] for x in r.main.collect()]
    # the good answers of the broken portion are kept, and nothing is asked twice but the failed record
    assert got[:6] == ["first"] * 6 and got[7] == got[9] == "second" and r.metrics == {"processed": 10, "ok": 10}
    assert len(list((tmp_path / "calls").iterdir())) == 11


def failing_no_more(folder):
    import uuid

    def answer(system, user):
        (folder / "calls" / uuid.uuid4().hex).write_text("")
        return '{"result":"second"}'

    return answer


def test_a_restart_asks_failed_records_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def failing(system, user):
        if '"name3"' in user or '"name8"' in user:
            raise RuntimeError("down")
        return '{"result":"first"}'

    cfg = config(continue_on_error=True, answers_path=str(tmp_path / "kept"), max_retries=1)
    r = run_job(spark, cfg, failing, people(spark))
    assert r.metrics == {"processed": 10, "ok": 8}
    r = run_job(spark, cfg, failing_no_more(tmp_path), people(spark))
    assert r.metrics == {"processed": 10, "ok": 10} and len(list((tmp_path / "calls").iterdir())) == 2
    assert [x["result"] for x in r.main.collect()] == ["second" if k in (3, 8) else "first" for k in range(10)]
    r = run_job(spark, cfg, failing_no_more(tmp_path), people(spark))
    assert r.metrics == {"processed": 10, "ok": 10} and len(list((tmp_path / "calls").iterdir())) == 2


class Clock:
    """Time that passes only while somebody waits."""

    def __init__(self):
        self.now, self.waits = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.waits.append(round(seconds, 3))
        self.now += seconds


def calls_logged(folder):
    def answer(system, user):
        import time
        import uuid

        (folder / f"{time.time_ns()}-{user}-{uuid.uuid4().hex}").write_text("")
        if user in ("r2", "r5"):
            raise RateLimited("slow down", 7) if user == "r5" else RuntimeError("oops")
        return "fine " + user

    return answer


def requests_of(spark, n=8):
    return spark.range(n).select(F.concat(F.lit("q"), "id").alias("request_id"), F.lit("").alias("system"), F.concat(F.lit("r"), "id").alias("user")).coalesce(1)


def test_a_failing_request_delays_no_other(spark, tmp_path):
    clock = Clock()
    done = generate_in_rounds(requests_of(spark), calls_logged(tmp_path), max_attempts=3, clock=clock, sleep=clock.sleep)
    got = {r["user"]: (r["response"], r["error"], r["attempts"]) for r in done.collect()}
    assert got["r2"] == (None, "oops", 3) and got["r5"] == (None, "slow down", 3) and got["r7"] == ("fine r7", None, 1) and len(got) == 8
    order = [p.name.split("-")[1] for p in sorted(tmp_path.iterdir())]
    assert order[:8] == [f"r{k}" for k in range(8)] and sorted(order[8:]) == ["r2", "r2", "r5", "r5"]
    assert clock.waits == [1.0, 2.0, 4.0, 7.0]  # r2 after 1 and 2 seconds, r5 after 7 and 7


def test_attempts_survive_a_restart(spark, tmp_path):
    calls, kept = tmp_path / "calls", str(tmp_path / "kept")
    calls.mkdir()

    class Stopped(Exception):
        pass

    def interrupted(seconds):
        raise Stopped

    with pytest.raises(Stopped):
        generate_in_rounds(requests_of(spark), calls_logged(calls), max_attempts=2, folder=kept, sleep=interrupted)
    assert len(list(calls.iterdir())) == 8
    prior, clock = earlier_tries(spark, kept, 2), Clock()
    done = generate_in_rounds(requests_of(spark, 9), calls_logged(calls), max_attempts=2, folder=kept, prior=prior, clock=clock, sleep=clock.sleep)
    got = {r["user"]: (r["response"], r["attempts"]) for r in done.collect()}
    # the two failed ones have one attempt left, the new one is sent, the others are not
    assert got["r2"] == got["r5"] == (None, 2) and got["r8"] == ("fine r8", 1) and got["r0"] == ("fine r0", 1)
    assert sorted(p.name.split("-")[1] for p in sorted(calls.iterdir())[8:]) == ["r2", "r5", "r8"] and clock.waits == []
    # attempts that are used up start anew
    again = {r["request_id"]: r["attempts"] for r in earlier_tries(spark, kept, 2).collect()}
    assert set(again) == {f"q{k}" for k in (0, 1, 3, 4, 6, 7, 8)}
    assert earlier_tries(spark, str(tmp_path / "none")) is None


def test_a_portion_reads_its_own_files(spark, tmp_path):
    from reqweave.plans.job import _portions

    rows = people(spark, 100).withColumnRenamed("id", ROW).withColumn("a `b`", F.lit(1))
    for cfg, want in ((config(portion_rows=30), [30, 30, 30, 10]), (config(first_portion=10), [10, 20, 40, 30])):
        seen, at = [], 0
        for start, end, portion in _portions(rows, cfg):
            ids = sorted(r[0] for r in portion.select(ROW).collect())
            assert start == at == ids[0] and ids == list(range(start, min(end, 100))) and portion.columns == rows.columns
            assert all("_portion=" in f for f in portion.inputFiles()) and len({f.split("_portion=")[1].split("/")[0] for f in portion.inputFiles()}) >= 1
            seen, at = [*seen, len(ids)], end
        assert seen == want


@pytest.mark.parametrize("sizes, n, changed", [((5, 10), 13, [2]), ((10, 5), 10, [])])
def test_a_restart_asks_for_all_that_is_missing(spark, tmp_path, sizes, n, changed):
    import uuid

    (tmp_path / "calls").mkdir()

    def second(system, user):
        (tmp_path / "calls" / uuid.uuid4().hex).write_text("")
        return '{"result":"second"}'

    sized = lambda rows: config(portion_rows=rows, answers_path=str(tmp_path / "kept"))
    run_job(spark, sized(sizes[0]), lambda s, u: '{"result":"first"}', people(spark))
    now = people(spark, n).withColumn("name", F.when(F.col("id").isin(changed), "changed").otherwise(F.col("name")))
    want = [(i, "second" if i >= 10 or i in changed else "first") for i in range(n)]
    for _ in range(2):  # the third run has nothing left to ask
        r = run_job(spark, sized(sizes[1]), second, now)
        got = r.main.collect()
        assert [(x["id"], x["result"]) for x in got] == want and [x["name"] for x in got] == [x["name"] for x in now.orderBy("id").collect()]
        assert r.metrics == {"processed": n, "ok": n} and len(list((tmp_path / "calls").iterdir())) == n - 10 + len(changed)


def test_tables_of_a_run_are_removed(spark, tmp_path):
    import os

    from reqweave.storage import run_tables

    with run_tables(spark) as folder:
        run_job(spark, config(dry_run=True), None, people(spark, 3)).main.write.parquet(str(tmp_path / "out"))
        assert os.listdir(folder)
    assert not os.path.exists(folder) and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_enrichment_needs_its_table(spark):
    cfg = config()
    cfg.enrich.enabled, cfg.enrich.column = True, "name"
    with pytest.raises(ValueError, match="lookup"):
        run_job(spark, cfg, always_ok, people(spark))


def test_records_with_equal_request_ids_stay_apart(spark):
    from reqweave.operators.agent import agent_rounds

    def step(messages, tools):
        if len(messages) == 2:
            return {"tool_calls": [{"id": "a", "name": "text_stats", "args": json.dumps({"text": messages[1]["content"]})}]}
        return {"content": str(json.loads(messages[3]["content"])["words"])}

    asked = spark.createDataFrame([("r", "", "one"), ("r", "", "one two"), (None, "", "one two three"), ("q", "", "one")], "request_id string, system string, user string")
    got = agent_rounds(asked, step, tools=["text_stats"])
    assert sorted((r["user"], r["response"]) for r in got.collect()) == [("one", "1"), ("one", "1"), ("one two", "2"), ("one two three", "3")]


def test_calls_are_answered_in_their_order_inside_the_row_or_by_key(spark, monkeypatch):
    from reqweave.operators import agent

    def step(messages, tools):
        n = int(messages[1]["content"])
        if len(messages) == 2 and n:
            return {"tool_calls": [{"id": f"c{k}", "name": None if k == 2 else "text_stats" if k % 2 else "guess", "args": json.dumps({"text": "a " * k})} for k in range(n)]}
        return {"content": json.dumps([[m.get("tool_call_id"), m.get("content")] for m in messages[3:]])}

    asked = spark.range(9).select(F.lit("r").alias("request_id"), F.lit("").alias("system"), F.col("id").cast("string").alias("user"))
    found = {}
    for most in (0, 2, 4, 100):
        monkeypatch.setattr(agent, "CALLS_IN_ROW", most)
        got = agent.agent_rounds(asked, step, tools=["text_stats", "regex_extract"]).collect()
        found[most] = sorted((r["user"], r["response"], r["error"], r["rounds"]) for r in got)
    assert found[0] == found[2] == found[4] == found[100] and len(found[0]) == 9
    assert [c[0] for c in json.loads(found[0][8][1])] == [f"c{k}" for k in range(8)]
    assert json.loads(found[0][8][1])[0][1] == "unknown tool: guess"


def test_messages_do_not_travel_for_a_few_calls(spark):
    from reqweave.operators import agent

    asked = spark.range(5).select(
        F.hash("id").alias("_key"), F.array().cast(f"array<{agent.MESSAGE}>").alias("_messages"),
        F.expr("named_struct('content', '', 'calls', array(named_struct('id', 'a', 'name', 'text_stats', 'args', '{\"text\":\"x\"}')), 'error', string(null))").alias("_step"),
    )
    answered = agent._answer_calls(asked, None, ["text_stats"], {})
    assert "Exchange" not in answered._jdf.queryExecution().executedPlan().toString()
    assert [len(r["_messages"]) for r in answered.collect()] == [2] * 5


def test_python_gets_long_texts_in_small_batches(spark):
    import pandas as pd

    from reqweave.session import prepare

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        texts = prepare(spark).range(400, numPartitions=1).select(F.repeat(F.substring(F.col("id").cast("string"), 1, 1), 100_000).alias("t"))
        assert texts.select(together("t").alias("n")).agg(F.max("n")).first()[0] < 8 << 20
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_rows_without_a_key_spread_over_the_tasks(spark):
    from reqweave.operators.enrich import enrich_lookup

    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise(" ").alias("k"))
        table = spark.range(0, 20_000, 10).select(F.col("id").cast("string").alias("key"), F.lit("hit").alias("result"))
        found = enrich_lookup(df, "k", table, "key", "result")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * sum(sizes) / len(sizes)
        assert found.where("enriched_k = 'hit'").count() == 2000 and found.where("enriched_k is null").count() == 18_000
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@pytest.fixture
def shuffled_joins(spark):
    """Neither broadcasts nor adaptive execution."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def partition_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_a_popular_key_is_dealt_over_the_tasks(spark, shuffled_joins):
    from reqweave.operators.enrich import answer_precedence, enrich_lookup

    n = 40_000
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, "warm").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", "h"), ("hot", "g"), ("7", "s"), ("cold", "c")], "key string, result string")
    found = enrich_lookup(df, "k", table, "key", "result")
    sizes = partition_sizes(found)
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < 2 * n / 8
    assert {(r["enriched_k"], r["count"]) for r in found.groupBy("enriched_k").count().collect()} == {("g", n // 2), ("s", 1), ("", n // 2 - 1)}
    asked = df.select(F.col("k").alias("query"), F.lit(None).cast("string").alias("abstract"), F.lit(None).cast("string").alias("answer"), F.array(F.struct(F.lit("t").alias("text"), F.concat(F.lit("http://x/"), "k").alias("url"))).alias("topics"))
    pages = spark.createDataFrame([("http://x/hot", "<p>page</p>"), ("http://x/other", "<p>no</p>")], "url string, html string")
    told = answer_precedence(asked, pages)
    sizes = partition_sizes(told)
    assert sum(sizes) == n and max(sizes) < 2 * n / 8 and told.where("result = 'page'").count() == n // 2


def test_a_job_of_many_answers_is_dealt_over_the_tasks(spark, shuffled_joins):
    from reqweave.operators.answers import check_answers, parse_strict
    from reqweave.operators.generate import dry_run_generate
    from reqweave.operators.spec import compile_spec, spec_frame

    n = 8000
    spec = compile_spec(spec_frame(spark, {"a": "int"}, "big").unionByName(spec_frame(spark, {"b": "string"}, "small")))
    asked = spark.range(n).select(F.col("id").alias(ROW), F.when(F.col("id") % 4 > 0, "big").otherwise("small").alias("job_id"))
    dry = dry_run_generate(asked, spec)
    sizes = partition_sizes(dry)
    assert sum(sizes) == n and max(sizes) < 2 * n / 8 and dry.where("response = '{\"a\":0}'").count() == n * 3 // 4
    answers = asked.withColumn("response", F.lit('{"a":1}'))
    checked = check_answers(parse_strict(answers, "response", F.lit(False)), spec)
    sizes = partition_sizes(checked)
    assert sum(sizes) == n and max(sizes) < 2 * n / 8
    assert checked.where("error is null").select("job_id").distinct().collect() == [("big",)]


def test_non_finite_numbers_are_defined(spark):
    from reqweave.functions.jsonvals import cell_text, value_json
    from pyspark.sql import types as T

    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,), (None,)], "x double")
    got = df.select(value_json(F.col("x"), T.DoubleType()), cell_text(F.col("x"), T.DoubleType())).collect()
    assert [tuple(r) for r in got] == [("null", "NaN"), ("null", "Infinity"), ("1.5", "1.5"), ("null", "")]


def test_restart_sends_only_what_is_open(spark):
    asked = spark.createDataFrame([("a", "", "x"), ("b", "", "y")], "request_id string, system string, user string")
    stored = materialize(generate(asked.where("request_id = 'a'"), lambda s, u: u.upper()), "answers")
    rest = unanswered(asked, stored)
    assert [r["request_id"] for r in rest.collect()] == ["b"]
    both = stored.unionByName(generate(rest, lambda s, u: u.upper()))
    assert sorted((r["request_id"], r["response"]) for r in join_responses(asked, both).collect()) == [("a", "X"), ("b", "Y")]


def test_row_numbers_are_dense_with_ties_and_copies(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("k"), F.lit("copy").alias("v"))
    numbered = row_index(df, ["k"]).groupBy("k").agg(F.min(ROW).alias("lo"), F.max(ROW).alias("hi"), F.count("*").alias("n")).orderBy("k").collect()
    assert [(r["lo"], r["hi"], r["n"]) for r in numbered] == [(0, 1666, 1667), (1667, 3333, 1667), (3334, 4999, 1666)]


def test_hot_group_is_numbered_in_many_partitions(spark):
    df = spark.range(0, 4000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).otherwise("hot").alias("g"), "id")
    got = number_in_group(df, "g", ["id"]).groupBy("g").agg(F.max("_group_idx").alias("hi"), F.count_distinct("_group_idx").alias("n")).collect()
    assert {(r["g"], r["hi"] + 1 == r["n"]) for r in got} == {(None, True), ("hot", True)}


def test_file_numbers_follow_the_files(spark):
    stored = materialize(spark.range(0, 1000, 1, 5), "ids")
    assert number_files(stored).where(F.col("id") != F.col(ROW)).count() == 0


def test_config_checks_everything_at_once():
    with pytest.raises(ValueError) as e:
        job_config({"input": {"type": "ftp"}, "processing": {"response_format": "pdf"}})
    assert all(s in str(e.value) for s in ["input_template is required", "unsupported input.type", "unsupported processing.response_format"])


def test_config_from_files(tmp_path):
    data = {"prompt": {"input_template": "x"}, "processing": {"max_retries": 5}}
    path = tmp_path / "job.json"
    path.write_text(json.dumps(data | {"api": {"model": "m"}, "input": {"separator": ";"}}))
    with pytest.raises(ValueError, match="unknown settings: api, input.separator"):
        load_config(str(path))
    path.write_text(json.dumps(data))
    cfg = load_config(str(path))
    assert isinstance(cfg, JobConfig) and cfg.processing.max_retries == 5 and cfg.processing.response_field == "response"
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "job.txt"))


def test_a_portion_is_read_by_many_tasks(spark, shuffled_joins, monkeypatch):
    from reqweave.operators.ordering import ROW
    from reqweave.plans import job

    files, asked = [], job._generated

    def counted(requests, *args):
        files.append(requests.select(F.input_file_name()).distinct().count())
        return asked(requests, *args)

    monkeypatch.setattr(job, "_generated", counted)
    cfg = config()
    cfg.processing.first_portion = 20
    records = spark.range(0, 160, numPartitions=8).select(F.col("id").alias(ROW), F.lit("Ann").alias("name"), F.col("id").alias("age"))
    got = job.run_records(records, cfg, always_ok).main
    assert got.count() == 160
    # the portion of 80 rows lies in 4 of the 8 tasks' rows
    assert len(files) == 4 and max(files) > 5
