"""Chat formatting in budgeted windows, in DataFrame operations only.

A turn is `<s>role\\ntext</s>`. Inside texts each control string gets a backslash after its first character (one
more, if it has some), so none is left and the escape can be undone; roles are URL-encoded.

Prefix sums of the turns' tokens choose spans of whole turns: a span goes on while its tokens fit what the
system turn and the history that is really repeated leave of the budget. Each later window repeats the system turn and then as
many of the turns before it as fit `history` tokens and leave room for the span's first turn; repeated turns are context, and only assistant texts of
the span itself are under the loss mask: each once. Only a turn that doesn't fit beside the system turn makes a window over the budget: it stands there without history
(in the first window, the system turn and the turn behind it stand together).

Turns are gathered in blocks of `block` turns, so a conversation with a third of all rows is no single task; a
later block starts with the system turn and with the turns before it that fit `history`, handed on as a small tail a block. Spans still
end where a block ends, so they can be shorter there. Nulls: a null text or role is empty, a null turn
comes first, rows with a null conv_id are one conversation. Repeated rows are turns of their own, ties go by role
and text. An empty table gives no windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quivra.llm.common import quoted

CONTROL = r"(/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def tokens(text: Column) -> Column:
    """The default estimate: a token for each four code points of the formatted turn."""
    return F.ceil(F.length(text) / 4).cast("long")


def windows(df: DataFrame, budget: int = 1024, history: int = 128, block: int = 1024, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", count=tokens) -> DataFrame:
    """(conv_id, block, window, n_context, n_turns, n_tokens, formatted, loss): loss has (start, length) in code points of formatted."""
    text = escape(F.coalesce(quoted(text_col).cast("string"), F.lit("")))
    role = F.coalesce(quoted(role_col).cast("string"), F.lit(""))
    head = F.concat(F.lit("<s>"), F.url_encode(role), F.lit("\n"))
    turn = quoted(turn_col).cast("long")
    line = F.concat(head, text, F.lit("</s>"))
    rows = df.select(quoted(conv_col).alias("conv_id"), F.coalesce(F.floor(turn / block), F.lit(0)).alias("block"), F.struct(turn.alias("turn"), role.alias("role"), line.alias("line"), F.length(head).alias("head"), F.length(text).alias("size"), count(line).alias("n")).alias("t"))
    gathered = lambda x: x.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("a"))
    turn_type = rows.schema["t"].dataType
    first = gathered(rows.filter("block <= 0")).withColumns({"system": F.lit(None).cast(turn_type), "tail": F.array().cast(f"array<{turn_type.simpleString()}>")})
    later = gathered(rows.filter("block > 0"))
    systems = rows.filter("block <= 0 and t.role = 'system'").groupBy("conv_id").agg(F.min("t").alias("system"))
    later = later.join(systems.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    tails = _tails(gathered(rows), history).withColumnsRenamed({"conv_id": "c", "block": "b"})
    later = later.join(tails, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").drop("c", "b")
    # the system turn is repeated anyway
    later = later.withColumn("tail", F.expr("filter(coalesce(tail, array()), x -> system is null or x != system)"))
    return _spans(first.unionByName(later), budget, history)


def _last(turns: str, history: int) -> Column:
    """The last turns of an array that fit the history."""
    return F.expr(f"""reverse(aggregate(reverse({turns}), named_struct('n', 0L, 'at', 0, 'on', true),
        (s, x) -> if(s.on and s.n + x.n <= {history}, named_struct('n', s.n + x.n, 'at', s.at + 1, 'on', true), named_struct('n', s.n, 'at', s.at, 'on', false)),
        s -> slice(reverse({turns}), 1, s.at)))""")


def _tails(blocks: DataFrame, history: int) -> DataFrame:
    """(conv_id, block, tail): the turns before each block that fit the history. A turn has a token at least, so `history` blocks reach back far enough."""
    own = blocks.select("conv_id", "block", _last("a", history).alias("z"), F.expr(f"aggregate(a, 0L, (s, x) -> s + x.n) > {history}").alias("full"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(-max(1, history), -1)
    # a block that does not fit whole ends the reach
    told = own.select("conv_id", "block", F.collect_list(F.struct("z", "full")).over(before).alias("x"))
    cut = f"aggregate(x, cast(array() as {blocks.schema['a'].dataType.simpleString()}), (s, b) -> if(b.full, b.z, concat(s, b.z)))"
    return told.withColumn("y", F.expr(cut)).select("conv_id", "block", _last("y", history).alias("tail"))


def _spans(blocks: DataFrame, budget: int, history: int) -> DataFrame:
    own = "(system is null and size(tail) = 0 and a[0].role = 'system')"
    step = blocks.withColumns({"k": F.expr(f"if({own}, 1, size(tail))"), "sys": F.expr(f"if({own}, a[0], system)"), "a": F.expr("concat(tail, a)")})
    step = step.withColumn("p", F.expr("aggregate(a, array(0L), (s, x) -> concat(s, array(element_at(s, -1) + x.n)))"))
    step = step.withColumn("room", F.lit(budget) - F.coalesce("sys.n", F.lit(0)))
    # the first turn repeated before turn s: what fits the history and leaves room for s
    back = lambda s: f"filter(sequence(if(size(tail) > 0, 0, k), {s}), j -> p[{s}] - p[j] <= greatest(0L, least({history}L, room - (p[{s} + 1] - p[{s}]))))[0]"
    first = f"if(size(tail) = 0, k, {back('k')})"
    # (first turn, first turn repeated) of each span: greedy over differences of prefix sums, which hold the repeated turns too
    starts = f"""if(size(a) <= k, array(named_struct('s', 0, 'h', 0)), aggregate(sequence(k, size(a) - 1), named_struct('at', array(named_struct('s', k, 'h', {first})), 'cur', k, 'h', {first}),
        (s, i) -> if(i > s.cur and p[i + 1] - p[s.h] > room, named_struct('at', concat(s.at, array(named_struct('s', i, 'h', {back('i')}))), 'cur', i, 'h', {back('i')}), s), s -> s.at))"""
    step = step.withColumn("starts", F.expr(starts))
    spans = """transform(starts, (x, w) -> named_struct('w', w, 's', if(w = 0 and size(tail) = 0, 0, x.s), 'e', coalesce(get(starts, w + 1).s, size(a)), 'h', x.h))"""
    step = step.withColumn("spans", F.expr(spans))
    context = "concat(if(sys is not null and (x.w > 0 or system is not null), array(sys), slice(a, 1, 0)), if(x.w = 0 and size(tail) = 0, slice(a, 1, 0), slice(a, x.h + 1, x.s - x.h)))"
    parts = step.select("conv_id", "block", F.explode(F.expr(f"transform(spans, x -> named_struct('window', x.w, 'context', {context}, 'own', slice(a, x.s + 1, x.e - x.s)))")).alias("x"))
    parts = parts.select("conv_id", "block", "x.window", "x.context", "x.own")
    before = "int(aggregate(context, 0L, (s, t) -> s + length(t.line)))"
    loss = f"""aggregate(own, named_struct('at', {before}, 'spans', cast(array() as array<struct<start:int,length:int>>)),
        (s, t) -> named_struct('at', s.at + length(t.line), 'spans', if(t.role = 'assistant', concat(s.spans, array(named_struct('start', s.at + t.head, 'length', t.size))), s.spans)), s -> s.spans)"""
    return parts.select(
        "conv_id", "block", "window", F.size("context").alias("n_context"), F.size("own").alias("n_turns"),
        F.expr("aggregate(concat(context, own), 0L, (s, t) -> s + t.n)").alias("n_tokens"),
        F.expr("array_join(transform(concat(context, own), t -> t.line), '')").alias("formatted"), F.expr(loss).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, block, window, turns, loss_text) from windows: turns (role, text) without context, and the unescaped text under the mask."""
    lines = F.split("formatted", "</s>", -1)
    new = F.slice(lines, F.col("n_context") + 1, F.size(lines) - 1 - F.col("n_context"))
    turns = F.transform(new, lambda x: F.struct(F.url_decode(F.substring_index(F.substr(x, F.lit(4)), "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))
    masked = F.transform("loss", lambda p: unescape(F.substr(F.col("formatted"), p["start"] + 1, p["length"])))
    return formatted.select("conv_id", "block", "window", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").alias("n_chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """One row a conversation: counts and SHA-256 of its turns and of the text under the mask, read from the windows."""
    per = read_back(formatted).withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
    whole = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "window", "said", "loss_text"))).alias("x"), F.sum(F.size("turns")).alias("n_turns"), F.sum("n_chars").cast("long").alias("formatted_chars"), F.sum(F.length("loss_text")).cast("long").alias("loss_chars"))
    sha = lambda c: F.sha2(F.array_join(F.transform("x", lambda w: w[c]), "").cast("binary"), 256)
    return whole.select("conv_id", "n_turns", sha("said").alias("turns_sha256"), "loss_chars", sha("loss_text").alias("loss_sha256"), "formatted_chars")
