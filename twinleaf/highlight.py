"""Terminal colours for PHP lines."""

from __future__ import annotations

from collections.abc import Sequence

from .sources.php import tokenize
from .sources.trees import ParseError

# Terminal colours by what a token is, and the words that are keywords or types.
COLORS = {"keyword": 94, "string": 32, "variable": 36, "comment": 90, "number": 33, "type": 35}
KEYWORDS = set(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield".split()
)
TYPES = {"int", "float", "string", "bool", "array", "object", "mixed", "void", "null", "never", "iterable", "callable", "self", "parent", "static", "false", "true"}
RESET = "\x1b[0m"
#: Marks a differing part, and the background of a diverging line.
DIFF = "\x1b[1;4m"
BACKGROUND = "\x1b[48;5;236m"
#: Takes a background away again without touching the foreground.
NO_BACKGROUND = "\x1b[49m"


class Highlighter:
    def __init__(self, enabled: bool = True):
        self.enabled = enabled

    def _wrap(self, code: str, text: str) -> str:
        return f"\x1b[{code}m{text}{RESET}" if self.enabled and text else text

    def dim(self, text: str) -> str:
        return self._wrap("2", text)

    def bold(self, text: str) -> str:
        return self._wrap("1", text)

    def line_number(self, text: str) -> str:
        return self._wrap("90", text)

    def spans(self, line: str) -> list[tuple[str, int | None]]:
        """The line in parts with their colour; what can't be read is plain."""
        out: list[tuple[str, int | None]] = []
        try:
            tokens = [t for t in tokenize(line, 1, True) if t.kind not in ("eof", "html")]
        except ParseError:
            return [(line, None)]
        at, before = 0, ""
        for k, t in enumerate(tokens):
            found = line.find(t.text, at)
            if found < 0:
                continue
            if found > at:
                gap = line[at:found]
                out.append((gap, COLORS["comment"] if gap.strip().startswith(("//", "#", "/*")) else None))
            out.append((t.text, self._color(t.kind, t.text, before, tokens[k + 1].text if k + 1 < len(tokens) else "")))
            at, before = found + len(t.text), t.text
        if at < len(line):
            rest = line[at:]
            out.append((rest, COLORS["comment"] if rest.strip().startswith(("//", "#", "/*")) else None))
        return out

    @staticmethod
    def _color(kind: str, text: str, before: str, after: str) -> int | None:
        if kind in ("single", "double", "heredoc", "nowdoc", "shell"):
            return COLORS["string"]
        if kind in ("variable", "number"):
            return COLORS[kind]
        if kind == "cast":
            return COLORS["type"]
        if kind == "name":
            word = text.lower()
            if before in ("->", "?->", "::"):
                return None
            if word in TYPES and after != "(" or before in (":", "?") and after != "(" and word not in KEYWORDS:
                return COLORS["type"]
            if word in KEYWORDS:
                return COLORS["keyword"]
        return None

    def highlight(self, line: str) -> str:
        if not self.enabled:
            return line
        return "".join(f"\x1b[{c}m{t}{RESET}" if c else t for t, c in self.spans(line))

    def highlight_with_diffs(self, line: str, ranges: Sequence[tuple[int, int]]) -> str:
        """A token that any of the byte ranges touches is marked whole."""
        if not self.enabled:
            return line
        out, at = [], 0
        for text, color in self.spans(line):
            end = at + len(text.encode())
            hit = any(a < end and b > at for a, b in ranges)
            code = (DIFF if hit else "") + (f"\x1b[{color}m" if color else "")
            out.append(f"{code}{text}{RESET}" if code else text)
            at = end
        return "".join(out)

    def background(self, text: str) -> str:
        """A background for the whole text, set again after each reset in it."""
        return BACKGROUND + text.replace(RESET, RESET + BACKGROUND) + NO_BACKGROUND + RESET if self.enabled else text
