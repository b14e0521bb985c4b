"""Job settings, checked on the driver before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

# Accepted formats and defaults.
INPUTS = ["csv", "xlsx", "json", "jsonl", "xml", "jdbc", "table"]
OUTPUTS = ["csv", "xlsx", "json", "jsonl", "xml", "jdbc", "table"]
RESPONSE_FORMATS = ["", "text", "json", "xml", "csv"]


@dataclass
class PromptConfig:
    system: str = ""
    pre_prompt: str = ""
    input_template: str = ""
    post_prompt: str = ""


@dataclass
class InputConfig:
    type: str = ""
    path: str = ""
    query: str = ""
    url: str = ""
    delimiter: str = ""
    has_header: bool = True
    root_path: str = ""
    record_path: str = ""
    schema: str = ""
    excluded_columns: list[str] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)


@dataclass
class OutputConfig:
    type: str = ""
    path: str = ""
    url: str = ""
    table: str = ""
    delimiter: str = ","
    group_by: str = ""


@dataclass
class EnrichConfig:
    enabled: bool = False
    column: str = ""
    output_field: str = ""
    max_chars: int = 0


@dataclass
class ToolsConfig:
    enabled: bool = False
    names: list[str] = field(default_factory=list)
    max_rounds: int = 5
    most_statements: int = 0


@dataclass
class ProcessingConfig:
    include_input_in_output: bool = False
    response_field: str = "response"
    parse_json_response: bool = False
    store_raw_response: bool = True
    include_thinking_in_response_field: bool = True
    debug_field: str = ""
    debug_field_hint: str = "short explanation in one sentence"
    strict_output: bool = True
    continue_on_error: bool = False
    first_portion: int = 1000
    portion_rows: int = 0
    answers_path: str = ""
    workers: int = 0
    rate_limit_rpm: int = 0
    max_retries: int = 3
    dry_run: bool = False
    batch_size: int = 0
    output_fields: list[str] = field(default_factory=list)
    key_column: str = ""
    response_format: str = ""
    response_schema: dict[str, str] = field(default_factory=dict)
    thinking: bool = False


@dataclass
class JobConfig:
    prompt: PromptConfig = field(default_factory=PromptConfig)
    input: InputConfig = field(default_factory=InputConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    processing: ProcessingConfig = field(default_factory=ProcessingConfig)
    enrich: EnrichConfig = field(default_factory=EnrichConfig)
    tools: ToolsConfig = field(default_factory=ToolsConfig)

    def problems(self) -> list[str]:
        """Everything that is wrong with the settings, not just the first thing."""
        p, found = self.processing, []
        if not self.prompt.input_template:
            found.append("prompt.input_template is required")
        if self.input.type and self.input.type.lower() not in INPUTS:
            found.append(f"unsupported input.type: {self.input.type}")
        if self.output.type and self.output.type.lower() not in OUTPUTS:
            found.append(f"unsupported output.type: {self.output.type}")
        if p.response_format.lower() not in RESPONSE_FORMATS:
            found.append(f"unsupported processing.response_format: {p.response_format}")
        if self.input.type.lower() == "xml" and not self.input.record_path:
            found.append("input.record_path is required for xml")
        if self.enrich.enabled and not self.enrich.column:
            found.append("enrich.column is required")
        return found

    def check(self) -> "JobConfig":
        found = self.problems()
        if found:
            raise ValueError("; ".join(found))
        return self


def _build(cls, data: dict[str, Any], where: str, unknown: list[str]):
    known = {f.name: f for f in fields(cls)}
    values = {}
    for name, value in data.items():
        if name not in known:
            unknown.append(where + name)
        elif value is not None:
            inner = known[name].default_factory
            nested = isinstance(value, dict) and is_dataclass(inner)
            values[name] = _build(inner, value, f"{where}{name}.", unknown) if nested else value
    return cls(**values)


def job_config(data: dict[str, Any]) -> JobConfig:
    """Settings from nested dictionaries; names that mean nothing here are an error."""
    unknown: list[str] = []
    cfg = _build(JobConfig, data, "", unknown)
    if unknown:
        raise ValueError("unknown settings: " + ", ".join(sorted(unknown)))
    return cfg.check()


def load_config(path: str) -> JobConfig:
    """Settings from a JSON file, or a YAML one where a YAML reader is installed."""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml as reader
        except ImportError as e:
            raise ValueError("reading YAML settings needs the yaml module") from e
        parse = reader.safe_load
    elif path.endswith(".json"):
        parse = json.load
    else:
        raise ValueError(f"unsupported config extension: {path}")
    with open(path, encoding="utf-8") as f:
        return job_config(parse(f))
