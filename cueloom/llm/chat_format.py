"""Chat formatting with SQL functions only.

A conversation's turns are collected as structs and sorted by turn, role and
text. Adjacent turns of one role share a block:

    ### role:
    text
    <+>
    text of the next turn of the same role
    </turn>

Inside texts and roles a backslash becomes ``\\s``, ``<`` becomes ``\\l`` and
``#`` becomes ``\\h`` (in roles also ``:`` becomes ``\\c``), so no control string
can occur there and the way back is exact. The loss mask is a run-length list
over the output's code points: (loss, chars), two runs a turn, what stands
before its text and its text; loss holds for assistant texts alone.

Reading back cuts the output at its control strings and holds the mask against
the cuts, run by run: each run has to be as long as what stands at its place, and
only texts may be trained. So the trained texts are those at the mask's own
offsets, found without counting code points from the start once a turn. A mask
that does not fit raises an error.

Work is linear in a conversation's length, which must fit one row, being one
string: Spark's limit is 2 GB. Null texts and roles are empty. Rows of a null
conv_id are one conversation. Repeated rows are turns of their own; turns of the
same number are ordered by role and text. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

END, MORE = "\n</turn>\n", "\n<+>\n"
TRAINED = "assistant"


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


CODES = [("\\", "\\s"), ("<", "\\l"), ("#", "\\h")]


def escaped(text: Column) -> Column:
    return _swap(text, CODES)


def unescaped(text: Column) -> Column:
    return _swap(text, [(b, a) for a, b in reversed(CODES)])


def _role_in(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def _role_out(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\c"), F.lit(":")))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (string) and loss_runs (array of (loss, chars)), per conversation."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    role_before = lambda i: F.get("turns", i - 1)["role"]
    head = lambda t: F.concat(F.lit("### "), _role_in(t["role"]), F.lit(":\n"))
    before = lambda t, i: F.when(i == 0, head(t)).when(role_before(i) == t["role"], F.lit(MORE)).otherwise(F.concat(F.lit(END), head(t)))
    laid = turns.select("conv_id", F.transform("turns", lambda t, i: F.struct(before(t, i).alias("before"), escaped(t["text"]).alias("text"), (t["role"] == TRAINED).alias("loss"))).alias("laid"))
    run = lambda loss, text: F.struct(loss.alias("loss"), F.length(text).alias("chars"))
    return laid.select(
        "conv_id",
        F.concat(F.array_join(F.transform("laid", lambda x: F.concat(x["before"], x["text"])), ""), F.lit(END)).alias("formatted"),
        F.concat(F.flatten(F.transform("laid", lambda x: F.array(run(F.lit(False), x["before"]), run(x["loss"], x["text"])))), F.array(run(F.lit(False), F.lit(END)))).alias("loss_runs"),
    )


def read_back(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of (role, text)) and trained (texts under the loss mask), from formatted and loss_runs."""
    blocks = F.split("formatted", END, -1)
    block = F.transform(
        F.slice(blocks, F.lit(1), F.size(blocks) - 1),
        lambda b: F.struct(
            F.substring_index(F.substr(b, F.lit(5)), ":\n", 1).alias("role"),
            F.split(F.regexp_replace(b, r"(?s)\A### [^:]*:\n", ""), "\n<\\+>\n", -1).alias("texts"),
        ),
    )
    head = lambda b, i: F.length(b["role"]) + F.when(i == 0, len("### :\n")).otherwise(len(END + "### :\n"))
    turn = lambda b, i: lambda t, j: F.struct(b["role"].alias("role"), t.alias("text"), F.when(j == 0, head(b, i)).otherwise(len(MORE)).alias("before"))
    told = rows.select("conv_id", "loss_runs", block.alias("blocks"))
    told = told.select("conv_id", "loss_runs", F.flatten(F.transform("blocks", lambda b, i: F.transform(b["texts"], turn(b, i)))).alias("turns"))
    lengths = F.concat(F.flatten(F.transform("turns", lambda t: F.array(t["before"], F.length(t["text"])))), F.array(F.lit(len(END))))
    only_texts = F.size(F.filter("loss_runs", lambda r, i: r["loss"] & (i % 2 == 0))) == 0
    fits = (lengths == F.transform("loss_runs", lambda r: r["chars"])) & only_texts
    told = told.withColumn("loss_runs", F.when(fits, F.col("loss_runs")).otherwise(F.raise_error(F.lit("the loss mask does not fit the text"))))
    return told.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(_role_out(t["role"]).alias("role"), unescaped(t["text"]).alias("text"))).alias("turns"),
        F.transform(F.filter("turns", lambda t, i: F.get("loss_runs", 2 * i + 1)["loss"]), lambda t: unescaped(t["text"])).alias("trained"),
    )


def format_report(conversations: DataFrame) -> DataFrame:
    """Digests of what the output says, read back from it; one row per conversation."""
    laid = formatted(conversations)
    keyed = F.struct("conv_id", F.length("formatted").cast("long").alias("chars")).alias("conv_id")
    back = read_back(laid.select(keyed, "formatted", "loss_runs"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("trained", "")
    return back.select(
        F.col("conv_id.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.col("conv_id.chars").alias("formatted_chars"),
    )
