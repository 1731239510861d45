"""Column expressions for redaction, trimming and normalization of free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentlens import constants as C

_CONTROL = "".join(chr(i) for i in range(0x21))
_VISIBLE = r"[^\t-\r\x1c-\x1f\p{Z}]|[\u00a0\u2007\u202f]"
_LINE_BREAK_CHARS = r"\n\x0b\f\r\x85\u2028\u2029"


def trim_control(text: Column) -> Column:
    """Strip every character up to U+0020 at both ends, not only spaces."""
    return F.btrim(text, F.lit(_CONTROL))


def not_blank(text: Column) -> Column:
    """True when the text holds a character that is not white space; false for null."""
    return F.coalesce(text.rlike(_VISIBLE), F.lit(False))


def _search(pattern: str) -> str:
    """A form of a fixed pattern that finds the same matches sooner."""
    if pattern in C.SEARCHED_AS:
        return C.SEARCHED_AS[pattern]
    return f"(?={C.BEGINS_WITH[pattern]}){pattern}" if pattern in C.BEGINS_WITH else pattern


def _replace_all(text: Column, rules) -> Column:
    return reduce(lambda col, rule: F.regexp_replace(col, _search(rule[0]), rule[1]), rules, text)


def _needs_all_patterns(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("bearer")) | F.contains(text, F.lit("@")) | text.rlike(C.LONG_NUMBER)


def redact(text: Column) -> Column:
    """Mask tokens, key=value secrets, e-mail addresses, phone and id numbers.

    Searching a pattern costs far more than looking for a word. Texts without ``bearer``, ``@`` and
    as many digits in a row as the shortest number has go through one pattern only. Masking never
    brings such a word, sign or run into a text, so the original text decides.
    """
    rules = [(p, C.MASK) for p in C.SECRET_PATTERNS]
    return F.when(_needs_all_patterns(text), _replace_all(text, rules)).otherwise(_replace_all(text, rules[1:2]))


def redact_each(*texts: Column) -> Column:
    """An array of redacted texts from one expression: a projection of many patterns becomes a method too long for the JVM to optimize.

    Functions over arrays are not compiled, so texts that hold nothing to mask, all joined, skip them.
    """
    joined = F.concat_ws("\n", *texts)
    found = _needs_all_patterns(joined) | joined.rlike(_search(C.SECRET_PATTERNS[1]))
    return F.when(found, F.transform(F.array(*texts), redact)).otherwise(F.array(*texts))


def redact_map(attributes: Column) -> Column:
    """Mask the value of a sensitive key outright and redact every other value."""
    masked = F.transform_values(
        attributes,
        lambda key, value: F.when(key.rlike(C.SENSITIVE_KEY), F.lit(C.MASK)).otherwise(redact(value)),
    )
    return F.coalesce(masked, F.create_map().cast("map<string,string>"))


def truncate(text: Column, limit: int = C.MAX_SAMPLE_CHARS) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit(C.ELLIPSIS))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def limit_stack_lines(stack: Column, lines: int = C.MAX_STACK_LINES) -> Column:
    """Keep the first lines of a stack trace; trailing empty lines do not count."""
    parts = F.split(stack, r"\R", lines + 1)
    has_more = (F.size(parts) > lines) & F.get(parts, F.lit(lines)).rlike(f"[^{_LINE_BREAK_CHARS}]")
    cut = F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n" + C.ELLIPSIS))
    return F.when(has_more, cut).otherwise(stack)


def normalize_message(message: Column, already_redacted: Column | None = None) -> Column:
    """The clustering template of a message: variable tokens become placeholders.

    ``already_redacted`` marks rows whose text went through :func:`redact` and was not cut
    afterwards; redacting those again cannot change them, so it is skipped. Without it the text is
    redacted here. Identifiers and times with dashes are only searched in texts with a dash; texts
    without digits and dashes can only hold identifiers made of hexadecimal letters.
    """
    def template(text: Column) -> Column:
        letters_only = [rule for rule in C.TEMPLATE_PATTERNS if rule[0] == C.LONG_HEX]
        undashed = [rule for rule in C.TEMPLATE_PATTERNS if rule[0] not in (C.UUID, C.ISO_TIMESTAMP)]
        return (
            F.when(F.contains(text, F.lit("-")), _replace_all(text, C.TEMPLATE_PATTERNS))
            .when(text.rlike("[0-9]"), _replace_all(text, undashed)).otherwise(_replace_all(text, letters_only)))

    masked = redact(message)
    if already_redacted is not None:
        masked = F.when(already_redacted, message).otherwise(masked)
    # one expression, as in redact_each
    return trim_control(F.get(F.transform(F.array(masked), template), F.lit(0)))


def top_stack_frame(stack: Column) -> Column:
    """The first ``at …`` line of a stack trace without its line number."""
    # white space behind a line break takes in the rest of a break of two characters; a dot stops at all breaks but two, which
    # are cut off by hand: repeating a class of all that is no break took two fifths of a cluster's text work
    line = F.regexp_extract(
        stack, rf"(?:\A|[{_LINE_BREAK_CHARS}])[\x00-\x20]*at ([\x00-\t\x0e-\x20]*[^\x00-\x20{_LINE_BREAK_CHARS}].*)", 1)
    frame = F.substring_index(F.substring_index(line, "\x0b", 1), "\f", 1)
    # a frame has visible characters, and so has what is left of it
    return F.nullif(trim_control(F.regexp_replace(trim_control(frame), r":\d+\)", ")")), F.lit(""))


def exception_class(stack: Column) -> Column:
    """Simple name of the first throwable in a stack trace; never taken from a message."""
    found = F.regexp_extract(stack, C.THROWABLE, 1)
    return F.nullif(F.substring_index(found, ".", -1), F.lit(""))


def exception_attributes(stack: Column) -> Column:
    name = exception_class(stack)
    empty = F.create_map().cast("map<string,string>")
    return F.when(name.isNotNull(), F.create_map(F.lit("exceptionClass"), name)).otherwise(empty)


def cluster_exception(explicit: Column, stack: Column) -> Column:
    """The explicit exception class, else the first stack line up to its first colon."""
    first_line = F.get(F.split(stack, r"\R", 2), F.lit(0))
    colon = F.instr(first_line, ":")
    head = F.when(colon > 1, F.substring_index(first_line, ":", 1)).otherwise(first_line)
    return F.when(not_blank(explicit), explicit).when(not_blank(stack), trim_control(head))


def cluster_key(project: Column, environment: Column, *parts: Column) -> Column:
    """Key text of a cluster; a missing part is rendered as the word ``null``."""
    return F.concat_ws(
        "|", project, environment, *[F.coalesce(p, F.lit("null")) for p in parts]
    )


def render_map(attributes: Column) -> Column:
    """``{k=v, …}`` with sorted keys, so that the text is the same on every run."""
    entries = F.array_sort(F.map_entries(attributes))
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "),
        F.lit("}"),
    )
