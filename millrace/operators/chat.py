"""Chat turns: streamed deltas, completion, prompts and responses, templates and assembled prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One event of a streamed completion.
EVENT = "struct<choices:array<struct<finish_reason:string,delta:struct<content:string>>>>"


def parse_event(line) -> Column:
    """(content, finish, failed) of a "data: {json}" line; null for any other line. [DONE] is done."""
    x = F.col(line) if isinstance(line, str) else line
    body = F.trim(F.substring(x, F.lit(6), F.length(x)))
    got = F.from_json(body, EVENT)
    finish = F.when(body == "[DONE]", "stop").otherwise(F.array_max(F.transform(got["choices"], lambda c: c["finish_reason"])))
    content = F.array_join(F.transform(F.coalesce(got["choices"], F.array().cast("array<struct<finish_reason:string,delta:struct<content:string>>>")), lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")
    failed = (body != "[DONE]") & got["choices"].isNull()
    return F.when(x.startswith("data:"), F.struct(content.alias("content"), finish.alias("finish"), failed.alias("failed")))


def accumulate(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, text, status) of every turn: complete on stop, length or [DONE], error on another reason or
    a line that isn't JSON, else open. What follows the end of a turn is left out."""
    e = lines.select(key, order, parse_event(line).alias("e")).where("e is not null")
    last = F.min(F.when(F.col("e.failed") | F.col("e.finish").isNotNull(), F.col(order))).over(Window.partitionBy(key))
    kept = e.withColumn("last", last).where(F.col("last").isNull() | (F.col(order) <= F.col("last")))
    parts = F.array_sort(F.collect_list(F.struct(order, F.when(~F.col("e.failed"), F.col("e.content")).otherwise("").alias("c"))))
    bad = F.max(F.col("e.failed") | ~F.coalesce(F.col("e.finish"), F.lit("stop")).isin("stop", "length"))
    done = F.max(F.col("e.finish").isNotNull())
    return kept.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("text"), F.when(bad, "error").when(done, "complete").otherwise("open").alias("status"))


def pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, prompt, response): user turns that an assistant's follows."""
    by = Window.partitionBy(conv).orderBy(turn)
    w = turns.select(conv, turn, "role", "text", F.lead("role").over(by).alias("__r"), F.lead("text").over(by).alias("response"))
    return w.where("role = 'user' and __r = 'assistant'").select(conv, turn, F.col("text").alias("prompt"), "response")


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    return turns.withColumn("turn_no", F.row_number().over(Window.partitionBy(conv).orderBy(turn)))


def turn_text(prompt="prompt", response="response") -> Column:
    """What is embedded of a turn."""
    return F.concat(F.lit("User: "), F.col(prompt), F.lit("\nAssistant: "), F.col(response))


def saved(turns: DataFrame, time: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of chats, and index entries under "id-time", of turns (id, prompt, response, model_name)."""
    chats = turns.select("id", "prompt", "response", "model_name", turn_text().alias("embedded_text"))
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return chats, turns.select(F.concat_ws("-", "id", stamp).alias("id"), F.lit("full").alias("kind"), F.concat_ws("\n", "prompt", "response").alias("body"))


def assemble(prompt: Column, outputs: list[Column], teams: Column | None = None, instructions: str = "", delimiter: str = "\n") -> Column:
    """The prompt with the outputs of tools before it, in order, joined by newlines; the teams' output
    comes after the instructions, right before the delimiter. No outputs leave the prompt as it is."""
    if not outputs and teams is None:
        return prompt
    parts = [F.concat(F.coalesce(o, F.lit("")), F.lit("\n")) for o in outputs]
    held = [F.lit(instructions)] + ([F.coalesce(teams, F.lit(""))] if teams is not None else [])
    return F.concat(*parts, *held, F.lit(delimiter), prompt)


class Tools:
    """Tools by name, in the order in which they were added; each is a function of a prompt column."""

    def __init__(self):
        self.all: dict[str, object] = {}
        self.enabled: set[str] = set()

    def add(self, name, function, enabled: bool = True):
        self.all[name] = function
        self.enabled |= {name} if enabled else set()

    def remove(self, name):
        self.all.pop(name, None)
        self.enabled.discard(name)

    def names(self):
        return list(self.all)

    def run(self, prompt: Column, teams: str | None = None, **how) -> Column:
        """The assembled prompt after all enabled tools; the one named ``teams`` is held back."""
        out = {n: f(prompt) for n, f in self.all.items() if n in self.enabled}
        held = out.pop(teams, None)
        return assemble(prompt, list(out.values()), held, **how)


def role_map(roles: DataFrame) -> DataFrame:
    """One row: roles as a map from name to instructions (a table of settings)."""
    return roles.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "instructions")))).alias("roles"))


def model_paths(messages: DataFrame, models: DataFrame) -> DataFrame:
    """Messages (id, model) with the path of the model of that name that was added last."""
    last = models.groupBy(F.col("name").alias("model")).agg(F.max_by("path", "id").alias("path"))
    return messages.join(last, "model")
