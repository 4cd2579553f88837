"""Rule patterns are written in the linear-time RE2 dialect; Spark runs Java regex.

``to_java`` rewrites a pattern once, when a rule is loaded, so that both find the same text.
``problems`` names what the dialect does not allow.
"""

from __future__ import annotations

import re
import warnings

from veilscan.functions.ambiguity import ambiguous
from veilscan.session import ship_by_value

ship_by_value(__name__)

WORD = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
INNER = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"

# One alternative per construct that reads differently in the two dialects.
TOKEN = re.compile(
    r"\\Q.*?(?:\\E|$)"      # quoted literal
    r"|\\x\{[0-9A-Fa-f]+\}"
    r"|\\[pP]\{[^}]*\}"
    r"|\\."                 # any escape
    r"|\[:\^?[a-z]+:\]"     # named class
    r"|\(\?:|\(\?[a-zA-Z-]+[:)]"  # plain group, flags
    r"|\[\^?\]?"            # start of a class; a first ] is literal
    r"|\]|&&|\$|.",
    re.DOTALL,
)

NAMED = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}",
    "cntrl": "\\p{Cntrl}", "digit": "0-9", "graph": "\\p{Graph}", "lower": "\\p{Lower}",
    "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\t-\\r ", "upper": "\\p{Upper}",
    "word": "0-9A-Za-z_", "xdigit": "\\p{XDigit}",
}

FORBIDDEN = (
    ("(?=", "lookahead"),
    ("(?!", "negative lookahead"),
    ("(?<=", "lookbehind"),
    ("(?<!", "negative lookbehind"),
    ("(?>", "atomic group"),
)
BACKREFERENCE = re.compile(r"\\[1-9]")
POSSESSIVE = re.compile(r"(?<!\\)[*+?}]\+")
# A repeated group whose body ends in an unbounded repeat, such as (,a+)+: Java calls itself for every round.
NESTED_REPEAT = re.compile(r"(?<!\\)[*+]\)(?:[*+]|\{\d+,\})")


class PatternError(ValueError):
    """The pattern is outside the supported dialect."""


# Constructs that ``spelled_out`` replaces; a class comes first, as most of them are plain inside.
SPELLED = re.compile(
    r"\[\^?\]?(?:\\.|\[:\^?[a-z]+:\]|[^\]\\])*\]"
    r"|\\Q(?P<quoted>.*?)(?:\\E|$)|\\x\{(?P<long>[0-9A-Fa-f]+)\}|\\x(?P<short>[0-9A-Fa-f]{2})"
    r"|\(\?P?<(?P<name>[A-Za-z_]\w*)>|\\.",
    re.DOTALL,
)
CODE = re.compile(r"\\x\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|\\.", re.DOTALL)
FLAGS = re.compile(r"(?<!\\)\(\?([a-zA-Z-]+)([:)])")


def literal(char: str) -> str:
    return "\\" + char if char.isascii() and char.isprintable() and not char.isalnum() and char != " " else char


def spelled_out(pattern: str) -> str:
    """The pattern with quoted stretches and character codes as the characters they stand for, and named
    groups as plain ones: only whole matches are used."""

    def code(found: re.Match) -> str:
        number = found[1] or found[2]
        return literal(chr(int(number, 16))) if number else found[0]

    def plain(found: re.Match) -> str:
        if found["quoted"] is not None:
            return "".join(literal(c) for c in found["quoted"])
        if found["name"]:
            return "("
        return CODE.sub(code, found[0])

    return SPELLED.sub(plain, pattern)


def problems(pattern: str) -> list[str]:
    """Constructs of ``pattern`` that rules may not use; empty when it is fine."""
    try:
        plain = spelled_out(pattern)
    except (ValueError, OverflowError) as err:
        return [f"invalid character code: {err}"]
    found = [f"{label} is not supported" for mark, label in FORBIDDEN if mark in plain]
    if BACKREFERENCE.search(plain):
        found.append("backreference is not supported")
    if POSSESSIVE.search(plain):
        found.append("possessive quantifier is not supported")
    if NESTED_REPEAT.search(plain):
        found.append("nested unbounded repeat is not supported: it can take exponential time or any depth of stack")
    if any(set(flags) - set("imsU-") for flags, _ in FLAGS.findall(plain)):
        found.append("invalid regular expression: unknown flag")
    names = [m["name"] for m in SPELLED.finditer(pattern) if m["name"]]
    if len(names) > len(set(names)):
        found.append("invalid regular expression: a group name occurs twice")
    if not found:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", FutureWarning)
                bare = FLAGS.sub(lambda m: "(?:" if m[2] == ":" else "", plain)
                tree = re.compile(re.sub(r"\\[pP](?:\{[^}]*\}|[A-Z])", "x", bare).replace("\\z", "$"))
        except re.error as err:
            found.append(f"invalid regular expression: {err}")
        else:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", FutureWarning)
                exponential = ambiguous(tree.pattern)
            if exponential:
                found.append("a repeat that can match one text in many ways is not supported: it can take exponential time")
    return found


OTHER_I = "(?-iu:[\\u0130\\u0131])"
NOT_OTHER_I = f"(?:(?!{OTHER_I})"


def class_holds_i(tokens: list[str]) -> bool:
    """Whether the character class that opens ``tokens`` holds an ASCII i, by letter or range, and no
    other i of its own."""
    body = "".join(tokens[: tokens.index("]", 1) + 1] if "]" in tokens[1:] else tokens)
    if "\u0130" in body or "\u0131" in body:
        return False
    body = re.sub(r"\\.|\[:\^?[a-z]+:\]", "", body)
    ranges = re.findall(r"([A-Za-z])-([A-Za-z])", body)
    return "i" in body.lower() or any(a <= c <= b for a, b in ranges for c in "iI")


def set_flags(token: str, now: dict[str, bool]) -> tuple[dict[str, bool], str]:
    """(flags after a flags token, the token without those that are worked into the pattern)."""
    on, _, off = token[2:-1].partition("-")
    after = {**now, **{f: True for f in on}, **{f: False for f in off}}
    on, off = on.replace("U", ""), off.replace("U", "")
    inner = on + (f"-{off}" if off else "")
    return after, f"(?{inner}{token[-1]}" if inner or token[-1] == ":" else ""


def to_java(pattern: str, ignore_case: bool = True, boundaries: bool = True) -> str:
    """Java form of a pattern. Without ``boundaries`` the word-boundary assertions are left
    out: that form finds something wherever the full one does, and scans several times
    faster, so it serves as a first test of a text."""
    faults = problems(pattern)
    if faults:
        raise PatternError("; ".join(faults))
    pattern = spelled_out(pattern)
    out, in_class, closing = [], False, "]"
    # Java folds dotless and dotted capital i to i, the dialect does not. Where case counts the guard
    # changes nothing, so flags inside the pattern need no tracking for it.
    folds = ignore_case or any("i" in flags.partition("-")[0] for flags, _ in FLAGS.findall(pattern))
    now, outer = {"m": False, "U": False}, []
    tokens = TOKEN.findall(pattern)
    skip = False
    for at, token in enumerate(tokens):
        if skip:
            skip = False
            continue
        after = tokens[at + 1] if at + 1 < len(tokens) else ""
        if token.startswith("[:") and in_class:
            negated, name = token[2] == "^", token.strip("[:^]")
            token = f"[^{NAMED[name]}]" if negated else NAMED[name]
        elif token in ("\\b", "\\B") and not in_class:
            token = {"\\b": BOUNDARY, "\\B": INNER}[token] if boundaries else ""
        elif token == "\\s":
            token = "\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]"
        elif token == "\\S":
            token = "[^\\t\\n\\f\\r ]"
        elif token == "\\v":
            token = "\\x0B"
        elif token == "\\C":
            raise PatternError("\\C is not supported")
        elif token.startswith("[") and not token.startswith("[:"):
            if in_class:
                token = "\\" + token
            else:
                in_class, closing, negated = True, "]", token.startswith("[^")
                guarded = folds and class_holds_i(tokens[at:])
                if guarded:
                    closing = f"]|{OTHER_I})" if negated else "])"
                token = (("(?:" if negated else NOT_OTHER_I) if guarded else "") + token.replace("]", "\\]")
        elif token == "]":
            token, in_class = (closing if in_class else token), False
        elif token in ("i", "I") and folds and not in_class:
            token = f"{NOT_OTHER_I}{token})"
        elif token in ("\u0130", "\u0131") and folds and not in_class:
            token = f"(?-iu:{token})"
        elif token == "&&" and in_class:
            token = "\\&\\&"
        elif not in_class:
            if FLAGS.fullmatch(token):
                changed, token = set_flags(token, now)
                if token.endswith(":"):
                    outer.append(now)
                now = changed
            elif token.startswith("("):
                outer.append(now)
            elif token == ")":
                now = outer.pop()
            elif token == "$" and not now["m"]:
                token = "\\z"
            elif now["U"] and (token in ("*", "+", "?") or token == "}" and REPEAT_END.search("".join(tokens[: at + 1]))):
                token, skip = (token, True) if after == "?" else (token + "?", False)
        out.append(token)
    # (?d): only a line feed ends a line; (?iu): case folding beyond ASCII.
    return lead(pattern, ignore_case) + ("(?diu)" if ignore_case else "(?du)" if folds else "(?d)") + "".join(out)


REPEAT_END = re.compile(r"\{\d+(?:,\d*)?\}$")


# Flags inside the pattern, and escapes that stand for other characters than the one that follows.
UNSURE = re.compile(r"\(\?(?!:|P?<[A-Za-z])|\\(?:[^bBdDwWsSAz\W]|_)")


def needed_literal(pattern: str, ignore_case: bool = True) -> str:
    """The longest plain text every match must hold, or '' where none is evident. Only
    characters outside groups and classes count, and letters only when case matters."""
    if UNSURE.search(pattern.replace("\\\\", "")):
        return ""
    runs, run, depth, in_class, plain = [], "", 0, False, True
    in_repeat = False
    tokens = TOKEN.findall(pattern) + [""]
    for token, after in zip(tokens, tokens[1:]):
        literal = False
        if in_class:
            in_class = token != "]"
        elif token.startswith("["):
            in_class = True
        elif token.startswith("("):
            depth += 1
        elif token == ")":
            depth -= 1
        elif token == "|" and depth == 0:
            plain = False
        elif depth == 0 and not in_repeat and len(token) == 1 and token not in "*+?{}.^$|":
            literal = after not in ("*", "?", "{") and not (ignore_case and token.isalpha())
        if literal:
            run += token
        else:
            runs, run = runs + [run], ""
        if token == "{":
            in_repeat = True
        elif token == "}":
            in_repeat = False
    return max(runs + [run], key=len) if plain else ""


# Characters outside ASCII that fold to an ASCII letter.
FOLDED = {"s": "\u017f", "k": "\u212a"}


def first_letters(pattern: str, ignore_case: bool = True) -> str:
    """All characters a match can begin with, where the pattern starts with plain letters,
    digits or a group of alternatives that do; '' where that is not evident."""
    if UNSURE.search(pattern.replace("\\\\", "")):
        return ""
    tokens = [t for t in TOKEN.findall(pattern)]
    while tokens and tokens[0] in ("\\b", "\\B"):
        tokens.pop(0)
    starts, depth, opening = [], 0, False
    if tokens[:1] == ["(?:"]:
        tokens, depth, opening = tokens[1:], 1, True
    simple = "|" not in tokens and re.match(r"\[([A-Za-z0-9-]+)\](?![*?]|\{0)", "".join(tokens))
    if simple and not opening and not ignore_case:
        return simple.group(1)
    for at, token in enumerate(tokens):
        if at == 0 or opening:
            after = tokens[at + 1] if at + 1 < len(tokens) else ""
            if after in ("*", "?") or (after == "{" and tokens[at + 2 : at + 3] == ["0"]):
                return ""
            if token == "\\d":
                starts.extend("0123456789")
            elif len(token) == 1 and token.isascii() and token.isalnum():
                starts.append(token)
            else:
                return ""
        opening = token == "|" and depth <= 1
        if depth == 0 and token == "|":
            return ""
        depth += token.startswith("(") - (token == ")")
        if depth == 0 and starts and token == ")":
            if any(t == "|" for t in tokens[at:]) or (tokens[at + 1 : at + 2] or [""])[0] in ("*", "?", "{"):
                return ""
            break
    if not ignore_case:
        return "".join(sorted(set(starts)))
    folded = {c for s in starts for c in (s.lower(), s.upper(), FOLDED.get(s.lower(), ""))}
    return "".join(sorted(folded))


def lead(pattern: str, ignore_case: bool) -> str:
    """Look-ahead for the first character of a match, or ''. It comes before everything else,
    so at most places of a text neither the boundaries nor the alternatives are tried."""
    letters = first_letters(pattern, ignore_case)
    return f"(?=[{letters}])" if letters else ""


def with_surroundings(java_pattern: str, window: int) -> str:
    """Pattern whose groups 1, 2, 3 are up to ``window`` characters before a match, the
    match, and up to ``window`` characters after it. The look-arounds consume nothing, so the
    matches are those of the plain pattern; the look-behind is tried only where one starts."""
    ahead, flags, body = re.match(r"(\(\?=\[[\w-]+\]\))?(\(\?d[iu]*\))(.*)", java_pattern, re.DOTALL).groups()
    before = f"(?s:\\A.{{0,{max(window - 1, 0)}}}|.{{{window}}})"
    body = capture_free(body)
    return f"{ahead or ''}{flags}(?=(?:{body}))(?<=({before}))((?:{body}))(?=((?s:.{{0,{window}}})))"


def capture_free(pattern: str) -> str:
    """Turn the capturing groups of a pattern into plain ones."""
    out, in_class, escaped = [], False, False
    for i, char in enumerate(pattern):
        out.append(char)
        if escaped:
            escaped = False
        elif char == "\\":
            escaped = True
        elif char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        elif char == "(" and not in_class and pattern[i + 1 : i + 2] != "?":
            out.append("?:")
    return re.sub(r"\(\?P?<[A-Za-z]\w*>", "(?:", "".join(out))
