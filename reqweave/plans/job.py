"""A whole job: read, enrich, ask, check, repair, merge, write."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from reqweave.config import JobConfig
from reqweave.session import prepare
from reqweave.operators.agent import agent_rounds
from reqweave.operators.answers import check_answers, parse_lenient, parse_strict, spread_fields
from reqweave.operators.attempts import NOT_ASKED, earlier_tries, generate_in_rounds
from reqweave.operators.batches import batch_user_text, keep_failed_rows, make_batches, split_batch_lenient, split_batch_strict
from reqweave.operators.enrich import enrich_lookup
from reqweave.operators.generate import audit_log, call_generator, call_pause, dry_run_generate, route_errors, unanswered
from reqweave.operators.merge import carry_input, member_names, output_fields, store_response
from reqweave.operators.ordering import ROW, exclude_columns, number_arrival, number_files, ordered_emit, row_index
from reqweave.operators.prompts import record_body, request_id, user_text
from reqweave.operators.spec import REPAIR_SYSTEM, OneJob, effective_schema, instructions_text, one_job, repair_text, spec_frame, system_text
from reqweave.sinks import files as to_files
from reqweave.sinks.tables import sink_sql
from reqweave.sinks.workbooks import sink_xlsx
from reqweave.sources import files as from_files
from reqweave.sources.tables import scan_sql
from reqweave.sources.workbooks import workbook_records
from reqweave.storage import materialize, new_folder

JOB = "job"
# What a stored answer adds to its request.
ANSWERED = ("response", "parsed", "call_error", "error", "attempts", "duration_ms")


@dataclass
class JobResult:
    """Output rows in input order, failed rows with their reports, counts, and the calls with their durations."""

    main: DataFrame
    errors: DataFrame
    metrics: dict[str, int]
    audit: DataFrame | None = None


def read_input(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """Records of the job's input; with ``input.schema`` nothing is looked at twice."""
    i, kind, schema = cfg.input, cfg.input.type.lower(), cfg.input.schema or None
    if kind == "csv":
        return from_files.scan_csv(spark, i.path, i.delimiter, i.has_header, placed=not i.order_by)
    if kind == "json":
        return from_files.scan_json(spark, i.path, i.root_path, schema, placed=not i.order_by)
    if kind == "jsonl":
        return from_files.scan_jsonl(spark, i.path, schema)
    if kind == "xml":
        return from_files.scan_xml(spark, i.path, i.record_path, schema)
    if kind == "xlsx":
        rows = workbook_records(spark, i.path, i.has_header)
        # workbooks in order of their names, rows as they stand
        return (rows if i.order_by else row_index(rows, ["path", "row_no"])).drop("path", "row_no")
    if kind == "jdbc":
        return scan_sql(spark, i.url, query=i.query)
    return spark.read.parquet(i.path)


def number_input(df: DataFrame, cfg: JobConfig) -> DataFrame:
    if ROW in df.columns:
        return df
    if cfg.input.order_by:
        return row_index(df, cfg.input.order_by)
    return number_arrival(df)


def job_spec(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    p = cfg.processing
    jobs = spark.createDataFrame(
        [(JOB, p.debug_field, p.debug_field_hint, p.response_field, p.response_format, p.parse_json_response)],
        "job_id string, debug_field string, debug_hint string, response_field string, response_format string, parse_json boolean",
    )
    return effective_schema(spec_frame(spark, p.response_schema, JOB), jobs)


def with_requests(records: DataFrame, cfg: JobConfig, job: OneJob, run: str) -> DataFrame:
    """Adds system, user and request_id to numbered records."""
    p, t = cfg.processing, cfg.prompt
    thinking = F.lit(p.thinking)
    structured = F.lit(bool(p.response_format or p.parse_json_response or p.response_schema or p.debug_field))
    body = record_body(records, t.input_template)
    text = instructions_text(thinking, job.text("field_lines"), job.text("example"))
    return (
        body.withColumn("system", system_text(F.lit(t.system), structured, thinking))
        .withColumn("user", user_text(F.col("_body"), t.pre_prompt, t.post_prompt, text))
        .withColumn("request_id", request_id(run, ROW, "system", "user"))
        .drop("_body")
    )


def checked(df: DataFrame, cfg: JobConfig, job: OneJob) -> DataFrame:
    """Adds parsed and error to answered requests; ``call_error`` wins."""
    p = cfg.processing
    if p.strict_output:
        out = check_answers(parse_strict(df, "response", F.lit(p.thinking)), job)
    else:
        out = parse_lenient(df, "response")
    return out.withColumn("error", F.coalesce("call_error", "error"))


def repaired(df: DataFrame, cfg: JobConfig, job: OneJob, fn: Callable) -> DataFrame:
    """One more request for answers that did not parse; kept if it passes.

    All rows pass through one stage and only the failed ones carry a prompt, so
    nothing is split off and joined back.
    """
    columns = df.columns
    broken = F.col("call_error").isNull() & F.col("error").isNotNull()
    prompt = repair_text(F.col("response"), job.text("field_lines"), job.text("example"))
    p = cfg.processing
    pause = call_pause(df, p.rate_limit_rpm, p.workers or None)
    called = df.withColumn("_again", call_generator(fn, F.lit(REPAIR_SYSTEM), F.when(broken, prompt), p.max_retries, pause=pause))
    first = {c: F.col(c).alias("_first_" + c) for c in ("response", "parsed", "error")}
    second = called.select(
        *[c for c in columns if c not in first], *first.values(), F.col("_again.response").alias("response")
    )
    second = checked(second, cfg, job)
    better = F.col("response").isNotNull() & F.col("error").isNull()
    return second.select(
        *[c for c in columns if c not in first],
        *[F.when(better, F.col(c)).otherwise(F.col("_first_" + c)).alias(c) for c in first],
    )


def _generated(requests: DataFrame, cfg: JobConfig, fn: Callable, folder: str = "", prior: DataFrame | None = None) -> DataFrame:
    """Calls by ``workers`` tasks, or where the rows are; failed ones wait in a table for their next round."""
    p = cfg.processing
    return generate_in_rounds(
        requests, fn, max_attempts=p.max_retries, partitions=p.workers or None, per_minute=p.rate_limit_rpm,
        stop=not p.continue_on_error, folder=folder, prior=prior,
    )


def _answered(requests: DataFrame, cfg: JobConfig, job: OneJob, fn, pages, prior: DataFrame | None = None, searches: DataFrame | None = None) -> DataFrame:
    p = cfg.processing
    if p.dry_run:
        return dry_run_generate(requests, job, p.response_field).withColumn("call_error", F.lit(None).cast("string"))
    if cfg.tools.enabled:
        pause = call_pause(requests, p.rate_limit_rpm, p.workers or None)
        spread = requests.repartition(p.workers) if p.workers else requests
        asked = agent_rounds(spread, fn, pages, cfg.tools.names, cfg.tools.max_rounds, p.max_retries, pause=pause, searches=searches, most_statements=cfg.tools.most_statements)
        return asked.drop("rounds").withColumnRenamed("error", "call_error")
    return _generated(requests, cfg, fn, p.answers_path.rstrip("/"), prior).withColumnRenamed("error", "call_error")


def _counted(df: DataFrame, name: str, path: str = "") -> tuple[DataFrame, dict[str, int]]:
    """Write the frame, to ``path`` if given, and count on the way."""
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("processed"), F.count_if(F.col("error").isNull()).alias("ok")]
    observed = df.observe(seen, *counts)
    if path:
        observed.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path), seen.get
    return materialize(observed, name), seen.get


def _finished(spark: SparkSession, folder: str) -> list[tuple[str, int, int | None]]:
    """Name, first and last row number of each portion that earlier runs of the job have finished.

    A mark without row numbers may stand for any rows.
    """
    try:
        marks = spark.read.schema("first long, last long").parquet(f"{folder}/done-*")
    except AnalysisException:
        return []
    name = F.regexp_extract("_metadata.file_path", "/done-([^/]+)/[^/]*$", 1)
    return [tuple(m) for m in marks.select(name, F.coalesce("first", F.lit(0)), "last").collect()]


def _kept(spark: SparkSession, folder: str, names: list[str]) -> DataFrame | None:
    """What was answered in the named portions, by request; failed calls are left out and asked again."""
    if not names:
        return None
    stored = [spark.read.parquet(f"{folder}/answers-{name}") for name in names]
    answers = [s.where("call_error IS NULL").select("request_id", *[c for c in ANSWERED if c in s.columns]) for s in stored]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), answers).dropDuplicates(["request_id"])


def _keep(spark: SparkSession, folder: str, name: str, counts: dict[str, int], first: int, last: int | None) -> None:
    """Mark a portion as finished; the mark is one small file, so it is there or not."""
    mark = spark.createDataFrame([(counts["processed"], counts["ok"], first, last)], "processed long, ok long, first long, last long")
    mark.coalesce(1).write.mode("overwrite").parquet(f"{folder}/done-{name}")


def run_records(
    records: DataFrame, cfg: JobConfig, fn=None, repair_fn=None, pages: DataFrame | None = None, run: str = "run", searches: DataFrame | None = None
) -> JobResult:
    """One request per record. ``fn(system, user)`` answers; with tools enabled
    ``fn(messages, tools)`` takes one step and ``repair_fn`` answers repairs. The tools read the stored ``pages`` and
    ``searches``, and the session's views for ``tools.most_statements`` different statements a round."""
    p, spark = cfg.processing, records.sparkSession
    prepare(spark)
    inputs = [c for c in records.columns if c != ROW]
    job = one_job(job_spec(spark, cfg), JOB)
    fixer = repair_fn or (None if cfg.tools.enabled else fn)
    parts, metrics, folder = [], {"processed": 0, "ok": 0}, p.answers_path.rstrip("/")
    finished = _finished(spark, folder) if folder else []
    prior = earlier_tries(spark, folder, p.max_retries) if folder and not p.dry_run and not cfg.tools.enabled else None
    names = {name for name, _, _ in finished}
    # in their order the rows of a portion would lie in the files of few tasks, which alone could read them
    dealt = records.repartition(F.col(ROW)) if _has_portions(cfg) else records
    for start, end, asked in _portions(with_requests(dealt, cfg, job, run), cfg):
        near = [name for name, first, last in finished if (end is None or first < end) and (last is None or last >= start)]
        kept, found = _kept(spark, folder, near), []
        if kept is not None:
            # the rows as they are now, with the answers to the same requests
            found.append(_counted(asked.join(kept, "request_id"), "kept-answers"))
            asked = unanswered(asked, kept)
        done = checked(_answered(asked, cfg, job, fn, pages, prior, searches), cfg, job)
        if p.strict_output and not p.dry_run and fixer is not None:
            done = repaired(done, cfg, job, fixer)
        name = next(n for n in (str(start), *(f"{start}-{k}" for k in range(1, len(names) + 2))) if n not in names)
        new = _counted(done, "answers", f"{folder}/answers-{name}" if folder else "")
        if folder and new[1]["processed"]:
            # marked before the job stops, so that the good answers of a broken portion are kept
            _keep(spark, folder, name, new[1], start, None if end is None else end - 1)
            names.add(name)
        if new[1]["ok"] < new[1]["processed"]:
            _stop_at_first(route_errors(new[0], ROW)[1], cfg)
        found.append(new)
        parts += [f for f, _ in found]
        metrics = {k: metrics[k] + sum(counts[k] for _, counts in found) for k in metrics}
    stored = reduce(DataFrame.unionByName, parts)
    good, errors = route_errors(stored, ROW)
    audit = audit_log(stored) if "duration_ms" in stored.columns else None
    return JobResult(_output(good, cfg, job, inputs), errors, metrics, audit)


def _has_portions(cfg: JobConfig) -> bool:
    p = cfg.processing
    return bool(p.portion_rows) or not (p.dry_run or p.continue_on_error and not p.answers_path)


def _portions(requests: DataFrame, cfg: JobConfig) -> Iterator[tuple[int, int | None, DataFrame]]:
    """The requests with the number of their first row and of the row behind their last one.

    Portions of ``portion_rows`` if given. Otherwise jobs that stop at an error, or keep their
    answers for a restart, go in portions of doubling size: few jobs, and after a failed
    portion no more calls are made. The requests are written once, by portion, so each portion reads its own files only.
    """
    p = cfg.processing
    if not _has_portions(cfg):
        yield 0, None, requests
        return
    size = max(1, p.portion_rows or p.first_portion)
    block = F.floor(F.col(ROW) / size)
    number = block if p.portion_rows else F.length(F.bin(block + 1)) - 1  # the portions hold 1, 2, 4, .. blocks
    folder = new_folder(requests.sparkSession, "requests")
    requests.withColumn("_portion", number.cast("long")).write.partitionBy("_portion").parquet(folder)
    written = requests.sparkSession.read.schema(f"{_ddl(requests)}, _portion long").parquet(folder)
    last, k = written.agg(F.max("_portion")).first()[0], 0
    while k <= (last or 0):
        start, blocks = (k, 1) if p.portion_rows else (2**k - 1, 2**k)
        yield start * size, (start + blocks) * size, written.where(F.col("_portion") == k).drop("_portion")
        k += 1


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _stop_at_first(errors: DataFrame, cfg: JobConfig) -> None:
    if not cfg.processing.continue_on_error:
        first = errors.where(F.col("error") != NOT_ASKED).orderBy(ROW).limit(1).collect()
        if first:
            raise RuntimeError(first[0]["report"])


def _output(good: DataFrame, cfg: JobConfig, job: OneJob, inputs: list[str], carried: list[str] | None = None) -> DataFrame:
    p = cfg.processing
    kinds = dict(job.kinds)
    if not kinds and p.output_fields:
        kinds = {n: "any" for n in p.output_fields if n not in inputs and n != p.response_field}
    keep = carry_input(inputs, p.include_input_in_output, p.key_column) if carried is None else carried
    raw = good.select(ROW, F.col("response").alias("_raw"), "parsed", *[F.col(f"`{c}`") for c in keep])
    out = spread_fields(raw, kinds)
    out = store_response(
        out, p.response_field, "_raw", p.thinking, p.include_thinking_in_response_field, p.store_raw_response, list(kinds)
    )
    out = ordered_emit(out).drop("_raw", ROW, *(["parsed"] if kinds else []))
    return output_fields(out, p.output_fields)


def run_batches(records: DataFrame, cfg: JobConfig, fn=None, run: str = "run") -> JobResult:
    """Several records per request; enrichment, tools and repair do not apply here."""
    p, spark = cfg.processing, records.sparkSession
    prepare(spark)
    inputs = [c for c in records.columns if c != ROW]
    job = one_job(job_spec(spark, cfg), JOB)
    batches = make_batches(record_body(records, cfg.prompt.input_template), p.batch_size)
    asked = batches.withColumn("system", F.lit(cfg.prompt.system)).withColumn(
        "user", batch_user_text(F.col("rows"), "_body", job.text("batch_lines"), F.lit(p.thinking), cfg.prompt.post_prompt)
    )
    if p.dry_run:
        answers = dry_run_generate(asked, job, p.response_field)
        items = F.array_join(F.transform("rows", lambda r: F.col("response")), ",")
        called = answers.withColumn("response", F.concat(F.lit("["), items, F.lit("]"))).withColumn("error", F.lit(None).cast("string"))
    else:
        called = _generated(asked, cfg, fn)
    called = materialize(called.withColumnRenamed("error", "call_error"), "batch-answers")
    keep = ["call_error"]
    split = split_batch_strict(called, job, keep=keep) if p.strict_output else split_batch_lenient(called, keep=keep)
    rows = keep_failed_rows(split.withColumn("error", F.coalesce("call_error", "error")))
    stored, metrics = _counted(rows.drop("_body", "item", "call_error"), "batch-rows")
    # only rows of failed batches are joined with the texts of their batch
    texts = called.select("batch_id", "system", "user", F.col("response").alias("_answer"))
    failed = stored.where(F.col("error").isNotNull()).join(texts, "batch_id").withColumn("response", F.col("_answer"))
    _, errors = route_errors(failed, ROW)
    _stop_at_first(errors, cfg)
    # failed batches keep their rows, with an empty response
    return JobResult(_output(stored, cfg, job, inputs, inputs if p.include_input_in_output else []), errors, metrics)


def spread_all(main: DataFrame, most: int = 1000) -> DataFrame:
    """Members of free JSON answers as columns: first the names, then the columns.

    More than ``most`` different names are an error; columns are part of the plan, so their number needs a bound.
    """
    names = [r["name"] for r in member_names(main).orderBy("name").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"answers have more than {most} different members, name the wanted ones in output_fields")
    return spread_fields(main, {n: "any" for n in names}).drop("parsed")


def run_job(
    spark: SparkSession, cfg: JobConfig, fn=None, records: DataFrame | None = None,
    lookup: DataFrame | None = None, lookup_key: str = "key", lookup_result: str = "result", **extra,
) -> JobResult:
    """Run the job of ``cfg`` on its own input or on ``records``; write its output if it names one."""
    cfg.check()
    source = read_input(spark, cfg) if records is None else records
    rows = number_input(exclude_columns(source, cfg.input.excluded_columns), cfg)
    if cfg.processing.batch_size > 1:
        result = run_batches(rows, cfg, fn, **extra)
    else:
        if cfg.enrich.enabled:
            if lookup is None:
                raise ValueError("enrich is switched on, but there is no lookup table")
            e = cfg.enrich
            rows = enrich_lookup(rows, e.column, lookup, lookup_key, lookup_result, e.output_field, e.max_chars)
        result = run_records(rows, cfg, fn, **extra)
    if cfg.output.type:
        write_output(result.main, cfg)
    return result


def write_output(main: DataFrame, cfg: JobConfig) -> None:
    o, kind = cfg.output, cfg.output.type.lower()
    if kind == "csv":
        to_files.sink_csv(main, o.path, o.delimiter)
    elif kind == "jsonl":
        to_files.sink_jsonl(main, o.path)
    elif kind == "xml":
        to_files.sink_xml(main, o.path)
    elif kind in ("json", "xlsx"):
        numbered = number_files(materialize(main, "output"))
        group = o.group_by or "_all"
        grouped = numbered if o.group_by else numbered.withColumn(group, F.lit("all"))
        # group and order are no part of the records
        (to_files.sink_json if kind == "json" else sink_xlsx)(grouped, o.path, group, [ROW], columns=main.columns)
    elif kind == "jdbc":
        sink_sql(main, o.url, o.table)
    else:
        main.write.parquet(o.path)
