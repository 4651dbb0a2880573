"""Dialogue formats as column expressions: prompts, messages, ChatML, pairs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dialoom.functions.clean import SPACE, TRAILING, col, let, light_clean, plain_text, strip, without_task

MESSAGES = "array<struct<role:string,content:string>>"
USER, AGENT = "用户：", "客服："
#: The task line, the default system prompt and the end marks.
TASK = "请根据下面的电商客服历史对话，生成下一句合适的客服回复。"
SYSTEM = "你是电商平台客服，请基于历史对话给出准确、礼貌、可执行的回复。"
END, EOS = "<|im_end|>", "<|endoftext|>"


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def speaker_lines(context: Column | str) -> Column:
    """Turns with their speakers by position: even ones are the buyer's."""
    return F.transform(F.coalesce(col(context), F.array().cast("array<string>")), lambda t, i: F.concat(F.when(i % 2 == 0, USER).otherwise(AGENT), F.coalesce(t, F.lit(""))))


def prompt_lines(context: Column | str) -> Column:
    return F.array_join(speaker_lines(context), "\n")


def task_prompt(context: Column | str) -> Column:
    """Task line, blank line, turns (a speaker that is there stays), an open agent line."""
    turns = F.transform(F.coalesce(col(context), F.array().cast("array<string>")), lambda t, i: F.when(t.rlike("^(用户|客服)："), t).otherwise(F.concat(F.when(i % 2 == 0, USER).otherwise(AGENT), F.coalesce(t, F.lit("")))))
    return F.concat_ws("\n", F.lit(TASK), F.lit(""), F.array_join(turns, "\n"), F.lit(AGENT))


def open_prompt(context: Column | str) -> Column:
    """Speaker lines with an open agent line at the end, if it is not there yet."""
    text = prompt_lines(context)
    return F.when(text.endswith("\n" + AGENT), text).otherwise(F.concat(text, F.lit("\n" + AGENT)))


def alpaca(instruction: Column, input_: Column, output: Column) -> Column:
    return F.struct(instruction.alias("instruction"), input_.alias("input"), output.alias("output"))


def parse_turns(c: Column | str) -> Column:
    """Messages of a prompt text, split at speaker markers anywhere; text before
    the first marker and empty turns are left out."""
    text = without_task(c)
    pieces = F.regexp_extract_all(text, F.lit("(?s)(用户：|客服：)(.*?)(?=用户：|客服：|\\z)"), F.lit(0))
    turns = F.transform(pieces, lambda p: message(F.when(p.startswith(USER), "user").otherwise("assistant"), light_clean(F.substring(p, 4, 2**31 - 1))))
    return F.filter(turns, lambda m: m["content"] != "")


def alpaca_to_messages(instruction: Column | str, input_: Column | str, output: Column | str) -> Column:
    """System, turns and answer; null where the answer is empty."""
    system, answer = light_clean(instruction), light_clean(output)
    made = F.concat(F.array(message("system", F.when(system == "", SYSTEM).otherwise(system))), parse_turns(input_), F.array(message("assistant", answer)))
    return F.when(answer != "", made)


def lines_to_context(c: Column | str) -> Column:
    """Turns of a hand-written prompt: each line after its first colon."""
    lines = F.filter(F.transform(F.split(plain_text(c), "\n"), strip), lambda x: x != "")
    after = lambda x, mark: strip(F.substring(x, F.instr(x, mark) + 1, F.lit(2**31 - 1)))
    turns = F.transform(lines, lambda x: F.when(x.contains("："), after(x, "：")).when(x.contains(":"), after(x, ":")).otherwise(x))
    return F.filter(turns, lambda x: x != "")


def prefixed_dialogue(c: Column | str) -> Column:
    """Messages of a line-oriented dialogue: a speaker starts a turn, other lines
    go on with it, text before the first speaker is the user's."""
    lines = F.split(plain_text(c), "\n")
    head = lambda x: F.regexp_extract(strip(x), "^(?i)(用户|买家|user|客服|卖家|assistant|系统|system)\\s*[：:]", 1)
    body = lambda x: strip(F.regexp_replace(strip(x), "^(?i)(用户|买家|user|客服|卖家|assistant|系统|system)\\s*[：:]", ""))
    role = lambda h: F.when(F.lower(h).isin("客服", "卖家", "assistant"), "assistant").when(F.lower(h).isin("系统", "system"), "system").otherwise("user")
    empty = F.array().cast(MESSAGES)

    def step(done: Column, x: Column) -> Column:
        start, n = head(x) != "", F.size(done)
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, n - 1), F.array(message(last["role"], F.concat_ws("\n", last["content"], strip(x)))))
        fresh = F.concat(done, F.array(F.when(start, message(role(head(x)), body(x))).otherwise(message("user", strip(x)))))
        return F.when(~start & (n > 0), longer).otherwise(fresh).cast(MESSAGES)

    turns = F.aggregate(F.filter(lines, lambda x: strip(x) != ""), empty, step)
    return F.filter(F.transform(turns, lambda m: message(m["role"], strip(m["content"]))), lambda m: m["content"] != "")


def normal_messages(c: Column | str) -> Column:
    """Known roles in lower case, contents without edges, empty ones left out."""
    turns = F.transform(F.coalesce(col(c), F.array().cast(MESSAGES)), lambda m: message(F.lower(strip(F.coalesce(m["role"], F.lit("")))), plain_text(m["content"])))
    return F.filter(turns, lambda m: m["role"].isin("system", "user", "assistant") & (m["content"] != ""))


def with_system(c: Column, prompt: str = SYSTEM, replace: bool = True) -> Column:
    """One system prompt at the start: replaced or kept if there is one, else put there."""
    system = F.array(message("system", F.lit(prompt)))
    has = F.coalesce(F.get(c, F.lit(0))["role"] == "system", F.lit(False))
    rest = F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.when(has, F.concat(system, rest) if replace else c).otherwise(F.concat(system, c))


def chatml(c: Column, generate: bool = False) -> Column:
    text = F.array_join(F.transform(c, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))), "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if generate else text


def terminated(c: Column, mode: str = "im_end", renew: bool = False) -> Column:
    """A completion with its end mark (im_end, eos, both); one that is there is
    left alone, or with `renew` taken off and put on again."""
    marks = {"im_end": END, "eos": EOS, "both": END + EOS}[mode]
    bare = F.regexp_replace(c, f"({SPACE}|<\\|im_end\\|>|<\\|endoftext\\|>)+$", "")
    if renew:
        return F.concat(bare, F.lit(marks))
    text = F.regexp_replace(c, TRAILING, "")
    return F.when(text.endswith(END) | text.endswith(EOS), text).otherwise(F.concat(text, F.lit(marks)))


def prompt_completion(c: Column | str, prompt: str = SYSTEM, replace: bool = True, mode: str = "im_end") -> Column:
    """struct(prompt, completion) of messages; null unless the last is the
    assistant's and something stands before it."""

    def made(turns: Column) -> Column:
        n = F.size(turns)
        ok = (n >= 2) & (F.try_element_at(turns, F.lit(-1))["role"] == "assistant")
        before = with_system(F.slice(turns, 1, F.greatest(n - 1, F.lit(0))), prompt, replace)
        return F.when(ok, F.struct(chatml(before, True).alias("prompt"), terminated(F.try_element_at(turns, F.lit(-1))["content"], mode).alias("completion")))

    return let(normal_messages(c), made)


def convert_rows(df, prompt: str = SYSTEM, mode: str = "im_end"):
    """`prompt, completion` from any of the layouts messages, prompt + completion
    (texts or messages), instruction + input + output, told by the columns once."""
    kinds = dict(df.dtypes)
    if "messages" in kinds:
        out = prompt_completion("messages", prompt, True, mode)
    elif {"prompt", "completion"} <= set(kinds):
        if kinds["prompt"] == "string":
            ok = (strip("prompt") != "") & (strip("completion") != "")
            out = F.when(ok, F.struct(plain_text("prompt").alias("prompt"), terminated(plain_text("completion"), mode).alias("completion")))
        else:
            out = prompt_completion(F.concat("prompt", "completion"), prompt, True, mode)
    else:
        out = prompt_completion(alpaca_to_messages("instruction", "input", "output"), prompt, True, mode)
    return df.withColumn("_out", out).where("_out is not null").select(*[c for c in df.columns if c not in ("prompt", "completion")], "_out.prompt", "_out.completion")


def convert_preferences(df, prompt: str = SYSTEM, mode: str = "im_end"):
    """`prompt, chosen, rejected` texts from preference rows in either layout."""
    turns = prefixed_dialogue("prompt" if "prompt" in df.columns else "input")
    text = chatml(with_system(turns, prompt), True)
    good, bad = plain_text("chosen"), plain_text("rejected")
    ok = (good != "") & (bad != "") & (good != bad) & (F.try_element_at(turns, F.lit(-1))["role"] == "user")
    out = F.when(ok, F.struct(text.alias("prompt"), terminated(good, mode).alias("chosen"), terminated(bad, mode).alias("rejected")))
    kept = [c for c in df.columns if c not in ("prompt", "chosen", "rejected")]
    return df.withColumn("_out", out).where("_out is not null").select(*kept, "_out.prompt", "_out.chosen", "_out.rejected")


def conversational(instruction: Column | str, input_: Column | str, output: Column | str) -> Column:
    """struct(prompt, completion) as messages; no system turn for an empty instruction."""
    system = plain_text(instruction)
    prompt = F.filter(F.array(F.when(system != "", message("system", system)), message("user", plain_text(input_))), lambda m: m.isNotNull())
    return F.struct(prompt.alias("prompt"), F.array(message("assistant", plain_text(output))).alias("completion"))


def eval_view(c: Column | str, prompt: str = SYSTEM) -> Column:
    """struct(prompt_messages, last_user, reference) of a row; null if malformed."""

    def made(turns: Column) -> Column:
        n = F.size(turns)
        before = F.slice(turns, 1, F.greatest(n - 1, F.lit(0)))
        last = F.try_element_at(F.filter(before, lambda m: m["role"] == "user"), F.lit(-1))["content"]
        ok = (n >= 2) & (F.try_element_at(turns, F.lit(-1))["role"] == "assistant") & last.isNotNull()
        return F.when(ok, F.struct(with_system(before, prompt).alias("prompt_messages"), last.alias("last_user"), F.try_element_at(turns, F.lit(-1))["content"].alias("reference")))

    return let(normal_messages(c), made)


def single_prompt(c: Column | str, prompt: str = SYSTEM) -> Column:
    return F.array(message("system", F.lit(prompt)), message("user", col(c)))


def model_label(adapter: Column | str) -> Column:
    """`base` or the name of the adapter's folder."""
    text = F.coalesce(F.regexp_replace(col(adapter), "/+$", ""), F.lit(""))
    return F.when(text == "", "base").otherwise(F.element_at(F.split(text, "/"), -1))


def fit_tokens(prompt: Column, completion: Column, most: int, most_prompt: int | None = None, most_completion: int | None = None) -> Column:
    """struct(prompt, completion): the completion keeps its start, the prompt its
    end, together at most `most` tokens."""
    done = F.slice(completion, 1, F.lit(min(most, most_completion or most)))
    room = F.greatest(F.lit(0), F.least(F.lit(most_prompt or most), F.lit(most) - F.size(done)))
    kept = F.slice(prompt, F.greatest(F.lit(1), F.size(prompt) - room + 1), room)
    return F.struct(kept.alias("prompt"), done.alias("completion"))


def padded(prompt: Column, completion: Column, width: int, pad: int = 0, ignore: int = -100) -> Column:
    """struct(input_ids, labels, attention): right padding, labels for the completion only."""
    ids = F.concat(prompt, completion)
    gap = F.greatest(F.lit(0), F.lit(width) - F.size(ids))
    labels = F.concat(F.transform(prompt, lambda _: F.lit(ignore)), completion, F.array_repeat(F.lit(ignore), gap))
    return F.struct(F.concat(ids, F.array_repeat(F.lit(pad), gap)).alias("input_ids"), labels.alias("labels"), F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("attention"))


def dialogue_turns(wrapper: Column, before: Column, last_user: Column) -> Column:
    """Messages of a made-up dialogue: wrapper, turns before, and the user's last one."""
    return F.concat(wrapper, before, F.array(message("user", last_user))).cast(MESSAGES)


def turns_sample(turns: Column, output: Column, prompt: str = SYSTEM) -> Column:
    """struct(instruction, input, output) of a dialogue whose last turn is the user's;
    null for any other."""
    lines = F.transform(turns, lambda m: F.concat(F.when(m["role"] == "user", USER).otherwise(AGENT), m["content"]))
    made = alpaca(F.lit(prompt), F.concat_ws("\n", F.lit(TASK), F.lit(""), F.array_join(lines, "\n"), F.lit(AGENT)), output)
    return F.when(F.try_element_at(turns, F.lit(-1))["role"] == "user", made)


def turns_messages(turns: Column, output: Column, prompt: str = SYSTEM) -> Column:
    """The same as messages: system, turns, answer."""
    made = F.concat(F.array(message("system", F.lit(prompt))), turns, F.array(message("assistant", output))).cast(MESSAGES)
    return F.when(F.try_element_at(turns, F.lit(-1))["role"] == "user", made)


def preference_prompt(text: Column, messages: Column, input_: Column, prompt: str = SYSTEM, replace: bool = True) -> Column:
    """The prompt of a preference row: its text if there is one, else its messages
    without a closing answer, else its input; null if it has none of them."""

    def made(turns: Column) -> Column:
        n = F.size(turns)
        before = F.when(F.try_element_at(turns, F.lit(-1))["role"] == "assistant", F.slice(turns, 1, F.greatest(n - 1, F.lit(0)))).otherwise(turns)
        single = F.array(message("user", plain_text(input_)))
        return F.when(plain_text(text) != "", plain_text(text)).when(F.size(before) > 0, chatml(with_system(before, prompt, replace), True)).when(plain_text(input_) != "", chatml(with_system(single, prompt), True))

    return let(normal_messages(messages), made)
