"""What requests, actions and messages say: tools, queries, prompts, token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

TOOLS = ["source", "grep", "traceback", "diff", "test_log", "tree", "generic"]
ALIASES = {
    **dict.fromkeys(("cat", "file", "read", "read_file", "sed", "source_file"), "source"),
    **dict.fromkeys(("rg", "ripgrep", "search"), "grep"),
    **dict.fromkeys(("pytest", "tests", "test"), "test_log"),
    **dict.fromkeys(("ls", "find", "directory"), "tree"),
    "git_diff": "diff",
}
#: The first of these whose words are anywhere in name and command tells the tool.
INFERRED = {
    "traceback": ("traceback", "stack trace"),
    "diff": ("git diff", "show diff", "patch"),
    "test_log": ("test",),
    "grep": ("grep", "rg ", "search", "find symbol"),
    "tree": ("tree", "list directory", "ls "),
    "source": ("cat", "read", "open file", "view file"),
}
#: Files that an action may be about.
CODE_SUFFIXES = "sh php rb hpp h cpp cc c java rs go tsx ts jsx js py".split()
MIN_CHARS = 1000


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _lines(*parts: Column) -> Column:
    """The parts that aren't blank, stripped, a line each."""
    return F.array_join(F.filter(F.transform(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), _strip), lambda x: x != ""), "\n")


def tool_alias(tool: Column) -> Column:
    """A supported tool type by name or alias; generic for any other."""
    name = F.translate(F.lower(_strip(tool)), "- ", "__")
    known = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), name), name)
    return F.when(known.isin(TOOLS), known).otherwise("generic")


def infer_tool(name: Column, command: Column, path: Column) -> Column:
    """The tool by what name and command contain; source with just a path, auto without one."""
    both = F.lower(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(command, F.lit(""))))
    out = F.when(F.coalesce(path, F.lit("")) != "", "source").otherwise("auto")
    for tool, words in reversed(INFERRED.items()):
        has = F.contains(both, F.lit(words[0]))
        for w in words[1:]:
            has = has | F.contains(both, F.lit(w))
        out = F.when(has, tool).otherwise(out)
    return out


def keep_ratio(threshold: Column) -> Column:
    """1 - threshold, from 0.01 to 1."""
    return F.greatest(F.lit(0.01), F.least(F.lit(1.0), 1.0 - threshold.cast("double")))


def too_short(text: Column, least: int = MIN_CHARS) -> Column:
    """Whether a client doesn't send an observation at all."""
    return F.length(F.coalesce(text, F.lit(""))) < least


def intent_text(query: Column, command: Column, path: Column, task: Column, recent: Column) -> Column:
    """What is asked, of the recent context the last 4,000 characters."""
    return _lines(query, command, path, task, F.right(recent, F.lit(4000)))


def posterior_text(focus: Column, command: Column, response: Column) -> Column:
    """What the next action says, of its response the first 800 characters."""
    return _lines(focus, command, F.left(response, F.lit(800)))


def surprisal_prompt(tool: Column, query: Column) -> Column:
    """The text before a candidate whose surprisal is asked for."""
    return _prompt("Estimate information in a coding-agent tool observation.", tool, "Current goal and context: ", query, F.lit("Candidate observation:"))


def next_action_prompt(instruction: str, tool: Column, query: Column, observation: Column) -> Column:
    """The text before an action whose likelihood is asked for."""
    return _prompt(instruction, tool, "Goal and recent context: ", query, F.lit("Tool observation:"), observation, F.lit("Next action:"))


def _prompt(first: str, tool: Column, asked: str, query: Column, *rest: Column) -> Column:
    goal = F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit(asked), query))
    return F.concat(F.concat_ws("\n", F.lit(first), F.concat(F.lit("Tool type: "), tool), goal, *rest), F.lit("\n"))


def query_symbols(query: Column) -> Column:
    """Distinct lower-case identifiers of a query, and their parts of more than one character."""
    whole = T.identifiers(query)
    parts = F.flatten(F.transform(whole, lambda x: F.split(x, r"[.:\-/]+")))
    return F.array_distinct(F.concat(whole, F.filter(parts, lambda x: F.length(x) > 1)))


def action_path(command: Column) -> Column:
    """The first word of a command that names a source file, without brackets and quotes around it; or empty."""
    words = F.transform(F.split(F.regexp_replace(command, "['\"]", " "), r"\s+"), lambda w: F.btrim(w, F.lit("()[]{};,:")))
    named = F.filter(words, lambda w: w.rlike(r"(?i)[^/]\.(?:" + "|".join(CODE_SUFFIXES) + ")/*$"))
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def action_query(focus: Column, command: Column, task: Column) -> Column:
    """The question of an action; else its command with the names of its paths, or the task's end without a command."""
    command = F.coalesce(command, F.lit(""))
    names = F.array_join(F.transform(T.extract_paths(command), lambda p: F.regexp_extract(p, "([^/]+)/*$", 1)), " ")
    end = F.when(~command.rlike(r"\S"), F.right(F.coalesce(task, F.lit("")), F.lit(1000)))
    own = F.array_join(F.filter(F.array(command, names, F.coalesce(end, F.lit(""))), lambda x: x != ""), "\n")
    return F.when(F.coalesce(focus, F.lit("")).rlike(r"\S"), _strip(focus)).otherwise(own)


def is_recovery(role: Column, content: Column, commands: Column) -> Column:
    """Whether an assistant's message fetches a raw observation, by its text or one of its commands."""
    asks = lambda x: F.contains(x, F.lit("/raw/")) & (F.contains(x, F.lit("curl")) | F.contains(x, F.lit("wget")))
    own = F.coalesce(asks(content), F.lit(False)) | F.coalesce(F.exists(commands, lambda c: F.coalesce(asks(c), F.lit(False))), F.lit(False))
    return F.coalesce(role == "assistant", F.lit(False)) & own


# ---- JSON of messages and reports


def first_value(payload: Column, *keys: str) -> Column:
    """The value of the first key that is there, as text, even if it is a JSON null."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(F.array_contains(F.json_object_keys(payload), key), F.get_json_object(payload, f"$.{key}")).otherwise(out)
    return out


def token_usage(message: Column) -> Column:
    """(prompt, completion, total, cached) tokens of a message's JSON; a total of 0 is the sum, and cached is null if it isn't told."""
    usage = F.get_json_object(message, "$.extra.response.usage")
    number = lambda *keys: F.coalesce(first_value(usage, *keys).try_cast("bigint"), F.lit(0))
    prompt, completion = number("prompt_tokens", "input_tokens"), number("completion_tokens", "output_tokens")
    total = number("total_tokens")
    details = first_value(usage, "prompt_tokens_details", "input_tokens_details")
    cached = F.coalesce(F.get_json_object(details, "$.cached_tokens"), F.get_json_object(usage, "$.cached_prompt_tokens")).try_cast("bigint")
    return F.struct(prompt.alias("prompt"), completion.alias("completion"), F.when(total == 0, prompt + completion).otherwise(total).alias("total"), cached.alias("cached"))


def count_value(payload: Column, *keys: str) -> Column:
    """The first of the keys' values that is a number (cut to an integer) or a list (its length)."""
    out = F.lit(None).cast("bigint")
    for key in reversed(keys):
        value = F.variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
        kind = F.schema_of_variant(value)
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, "$", "double").cast("bigint"))
        out = F.coalesce(number, F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get(value, "$", "array<variant>")).cast("bigint")), out)
    return out


def pruning_stats(message: Column, key: str = "pruning") -> Column:
    """The JSON of a message's pruning statistics under a key: its own, those of a fork (nested ones first), or those under extra."""
    at = lambda path: F.when(F.get_json_object(message, path).startswith("{"), F.get_json_object(message, path))
    return F.coalesce(at(f"$.{key}"), at(f"$.pruned_stats.{key}"), at("$.pruned_stats"), at(f"$.extra.{key}"))


def prediction_ids(predictions: Column) -> Column:
    """Sorted ids of a JSON map of predictions: an entry's instance_id, else task_id, else its key."""
    entries = F.map_entries(F.from_json(predictions, "map<string,string>"))
    one = lambda e: F.coalesce(F.nullif(F.get_json_object(e["value"], "$.instance_id"), F.lit("")), F.nullif(F.get_json_object(e["value"], "$.task_id"), F.lit("")), e["key"])
    return F.array_sort(F.transform(entries, one))


def anchor_lines(anchors: Column) -> Column:
    """Distinct line numbers of an array of texts; what is no integer is passed over."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(anchors, lambda x: x.try_cast("int")), lambda x: x.isNotNull())))
