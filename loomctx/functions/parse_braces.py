"""Top-level declarations and imports of TypeScript, JavaScript and Java sources.

A mask blanks out strings, comments, templates and regular expressions, keeping every place; brackets are then matched on the
mask. Declarations are looked for where a line begins outside of all brackets. This is a documented subset of the languages: several
statements on one line count as one, and a slash after ``)`` or a word divides.
"""

from __future__ import annotations

import re

from loomctx.functions.parse_python import decl, flat

_OPEN, _CLOSE = "([{", ")]}"
_REGEX_AFTER = set("(,=:[!&|?{};+-*%<>~^")
_WORDS_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do")


def mask(src: str, script: bool) -> str:
    """The text with everything in literals and comments blank; line ends stay."""
    out, i, n = list(src), 0, len(src)
    nesting: list[int] = []  # braces open inside each template substitution

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    def template(a: int) -> int:
        k = a
        while k < n:
            if src[k] == "\\":
                k += 2
            elif src[k] == "`":
                blank(a, k + 1)
                return k + 1
            elif src.startswith("${", k):
                blank(a, k + 2)
                nesting.append(0)
                return k + 2
            else:
                k += 1
        blank(a, n)
        return n

    while i < n:
        c = src[i]
        if src.startswith("//", i):
            j = src.find("\n", i)
            j = n if j < 0 else j
            blank(i, j)
            i = j
        elif src.startswith("/*", i):
            j = src.find("*/", i + 2)
            j = n if j < 0 else j + 2
            blank(i, j)
            i = j
        elif not script and src.startswith('"""', i):
            j = src.find('"""', i + 3)
            j = n if j < 0 else j + 3
            blank(i, j)
            i = j
        elif c in "\"'":
            j = i + 1
            while j < n and src[j] != c and src[j] != "\n":
                j += 2 if src[j] == "\\" else 1
            blank(i, j + 1)
            i = j + 1
        elif script and c == "`":
            blank(i, i + 1)
            i = template(i + 1)
        elif script and c == "/":
            before = "".join(out[max(0, i - 200) : i]).rstrip()
            word = re.search(r"[\w$]+$", before)
            if not before or before[-1] in _REGEX_AFTER or (word and word[0] in _WORDS_BEFORE_REGEX):
                j, inside = i + 1, False
                while j < n and src[j] != "\n" and (src[j] != "/" or inside):
                    inside = True if src[j] == "[" else False if src[j] == "]" else inside
                    j += 2 if src[j] == "\\" else 1
                if j < n and src[j] == "/":
                    blank(i, j + 1)
                    i = j + 1
                    continue
            i += 1
        elif nesting and c == "{":
            nesting[-1] += 1
            i += 1
        elif nesting and c == "}":
            if nesting[-1] == 0:
                nesting.pop()
                blank(i, i + 1)
                i = template(i + 1)
            else:
                nesting[-1] -= 1
                i += 1
        else:
            i += 1
    return "".join(out)


class Source:
    """A masked text with its bracket structure."""

    def __init__(self, src: str, script: bool):
        self.src, self.mask = src, mask(src, script)
        self.depth, self.partner, stack, d = [0] * (len(src) + 1), {}, [], 0
        for i, c in enumerate(self.mask):
            if c in _CLOSE and stack:
                a = stack.pop()
                self.partner[a] = i
                d -= 1
            self.depth[i] = d
            if c in _OPEN:
                stack.append(i)
                d += 1
        self.depth[len(src)] = d

    def close(self, at: int) -> int:
        """Place after the bracket that closes the one at ``at``."""
        return self.partner.get(at, len(self.src) - 1) + 1

    def find(self, chars: str, start: int, depth: int, stop: int | None = None) -> int:
        """First of the characters at this depth, or -1."""
        for i in range(start, len(self.src) if stop is None else stop):
            if self.mask[i] in chars and self.depth[i] == depth:
                return i
        return -1

    def starts(self):
        """Places where a line begins outside of all brackets."""
        for m in re.finditer(r"^[ \t]*(?=\S)", self.mask, re.M):
            if self.depth[m.end()] == 0:
                yield m.end()

    def made(self, kind, name, start, end, signature, **more) -> dict:
        a, b = len(self.src[:start].encode()), len(self.src[start:end].encode())
        line = self.src.count("\n", 0, start) + 1
        return decl(kind, name, a, a + b, line, line + self.src.count("\n", start, end), signature, **more)

    def members(self, body: int):
        """(start, end, place of the member's own block or None) of the members in the braces at ``body``."""
        stop, depth, i = self.close(body) - 1, self.depth[body] + 1, body + 1
        while i < stop:
            if self.mask[i].isspace() or self.mask[i] in ";,":
                i += 1
                continue
            block = None
            k = i
            while k < stop:
                c = self.mask[k]
                if self.depth[k] == depth and c == ";":
                    k += 1
                    break
                if c == "{" and self.depth[k] == depth:
                    assigned = re.search(r"=(?![=>])", self.mask[i:k])
                    end = self.close(k)
                    if not assigned:
                        block = k
                        k = end
                        break
                    k = end
                    continue
                if c == "\n" and self.depth[k] == depth and re.search(r"[\w)\]}'\"`]\s*$", self.mask[i:k]) and self.script_line_end(k, stop):
                    break
                k += 1
            yield i, k, block
            i = max(k, i + 1)

    script = False

    def script_line_end(self, k: int, stop: int) -> bool:
        """Whether a member without a semicolon ends at this line end."""
        rest = self.mask[k:stop].lstrip()
        return self.script and bool(rest) and (rest[0].isalnum() or rest[0] in "_$#@[}")


# --- TypeScript and JavaScript -----------------------------------------------------------------------------------

_TS_IMPORT = re.compile(r"import\b")
_TS_HEAD = re.compile(
    r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:(?P<function>(?:async\s+)?function\b\s*\*?\s*)|(?P<class>(?:abstract\s+)?class\s+)|(?P<interface>interface\s+)|(?P<enum>(?:const\s+)?enum\s+)|(?P<type>type\s+)|(?P<var>(?:const|let|var)\s+))(?P<name>[\w$]+)"
)
_ARROW = re.compile(r"(?:async\s*)?(?:<[^()]*>\s*)?(?:(?P<paren>\()|[\w$]+\s*=>)")
_TS_CALL = re.compile(r"(?P<before>(?:\bnew\s+|\bfunction\s*\*?\s*|#)?)(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w\s,.\[\]|&$]*>)?\s*(?:\?\.)?\(")
_NO_CALL = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "constructor", "of", "in", "new", "delete", "void", "throw", "else", "do", "case", "yield", "async", "get", "set", "static"}


def _ts_calls(s: Source, start: int, end: int, member_depth: int | None) -> list[str]:
    out = []
    for m in _TS_CALL.finditer(s.mask, start, end):
        paren = m.end() - 1
        if m["before"] or m["name"] in _NO_CALL:
            continue
        after = s.mask[s.close(paren) : s.close(paren) + 200].lstrip()
        if member_depth is not None and s.depth[paren] == member_depth and after[:1] in ("{", ":") and not s.mask[: m.start()].rstrip().endswith("."):
            continue  # a method
        out.append(m["name"])
    return out


def _statement_end(s: Source, at: int) -> int:
    """End of a statement: its semicolon, or the line end that no operator continues."""
    i = at
    while i < len(s.src):
        c = s.mask[i]
        if s.depth[i] == 0 and c == ";":
            return i + 1
        if s.depth[i] == 0 and c == "\n":
            rest = s.mask[i:].lstrip()
            before = s.mask[at:i].rstrip()
            if not (rest[:1] and rest[0] in ".|&?:+*=") and not before.endswith(("=", "|", "&", "=>", ",", "+", "?", ":")):
                return i
        i += 1
    return len(s.src.rstrip())


def scan_typescript(text: str) -> tuple[list[dict], list[str]]:
    s = Source(text, True)
    s.script = True
    decls, imports, done = [], [], 0
    for at in s.starts():
        if at < done:
            continue
        if _TS_IMPORT.match(s.mask, at) and not re.match(r"import\s*[(.]", s.mask[at : at + 20]):
            end = _statement_end(s, at)
            found = re.search(r"(?:from\s*|import\s*)([\"'])(.+?)\1", s.src[at:end])
            if found:
                imports.append(found[2])
            done = end
            continue
        m = _TS_HEAD.match(s.mask, at)
        if not m:
            continue
        kind = next(k for k in ("function", "class", "interface", "enum", "type", "var") if m[k])
        name = m["name"]
        if kind == "var":
            equals = s.find("=", m.end(), 0, _statement_end(s, at))
            value = equals + 1 + len(s.mask[equals + 1 :]) - len(s.mask[equals + 1 :].lstrip()) if equals > 0 else -1
            if value < 0:
                continue
            made = re.compile(r"(?:async\s+)?function\b").match(s.mask, value)
            if made:
                body = s.find("{", value, 0)
                end = s.close(body) if body >= 0 else len(text)
            else:
                arrow = _ARROW.match(s.mask, value)
                if not arrow:
                    continue
                after = s.close(arrow.end() - 1) if arrow["paren"] else arrow.end() - 2
                sign = s.mask.find("=>", after)
                if sign < 0 or (arrow["paren"] and not re.fullmatch(r"\s*(?::[^;]*)?", s.mask[after:sign])):
                    continue
                body = sign + 2 + len(s.mask[sign + 2 :]) - len(s.mask[sign + 2 :].lstrip())
                end = s.close(body) if s.mask[body : body + 1] == "{" else _statement_end(s, body)
            if s.mask[end : end + 1] == ";":
                end += 1
            decls.append(s.made("function", name, at, end, f"{flat(text[at:body])} ...\n", calls=_ts_calls(s, value, end, None)))
        elif kind == "type":
            end = _statement_end(s, m.end())
            decls.append(_typeish(s, "type", name, at, end))
        else:
            body = s.find("{", m.end(), 0)
            short = s.find(";", m.end(), 0)
            if body < 0 or (kind == "function" and 0 <= short < body):
                continue
            end = s.close(body)
            if kind == "function":
                # a return type may be an object type: the body is the last block of the declaration
                again = s.mask[end:].lstrip()
                if again.startswith("{"):
                    body = end + s.mask[end:].index("{")
                    end = s.close(body)
                decls.append(s.made("function", name, at, end, f"{flat(text[at:body])} ...\n", calls=_ts_calls(s, s.mask.index("(", m.end()) + 1, end, None)))
            elif kind == "class":
                head = s.mask[m.end() : body]
                extends = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|$)", head, re.S)
                implements = re.search(r"\bimplements\s+(.*)$", head, re.S)
                lines = []
                for a, b, block in s.members(body):
                    header = flat(text[a : b if block is None else block])
                    if "(" in header.split("=")[0]:
                        lines.append(f"  {header.rstrip(';')} ...\n")
                    elif header:
                        lines.append(f"  {header.rstrip(';')}\n")
                names = lambda g: re.findall(r"(?<!\.)\b[A-Za-z_$][\w$]*", g[1]) if g else []
                decls.append(s.made("class", name, at, end, f"{flat(text[at:body])} {{\n{''.join(lines)}}}\n", calls=_ts_calls(s, body, end, 1), bases=names(extends), impls=names(implements)))
            else:
                decls.append(_typeish(s, kind, name, at, end))
        done = end
    return decls, imports


def _typeish(s: Source, kind: str, name: str, at: int, end: int) -> dict:
    """Short types are their own signatures."""
    text = s.src[at:end]
    return s.made(kind, name, at, end, f"{text}\n" if len(text.splitlines()) <= 12 else f"{flat(text.splitlines()[0])} ...\n")


# --- Java ---------------------------------------------------------------------------------------------------------

_JAVA_HEAD = re.compile(r"(?:@[\w.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s+)*(?:(?:public|protected|private|abstract|final|static|sealed|non-sealed|strictfp)\s+)*(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>\w+)")
_JAVA_CALL = re.compile(r"(?P<before>(?:@|\bnew\s+)?)(?P<path>(?:[\w$]+\s*\.\s*)*)(?P<name>[A-Za-z_$][\w$]*)\s*(?P<generic><[^()<>;{}]*(?:<[^()<>;{}]*>[^()<>;{}]*)*>)?\s*\(")
_JAVA_NO_CALL = {"if", "for", "while", "switch", "catch", "synchronized", "return", "this", "super", "try", "assert", "throw", "new", "else", "do", "case"}


def scan_java(text: str) -> tuple[list[dict], list[str]]:
    s = Source(text, False)
    decls, imports, done = [], [], 0
    for at in s.starts():
        if at < done:
            continue
        found = re.compile(r"import\s+(?:static\s+)?([\w.*\s]+?)\s*;").match(s.mask, at)
        if found:
            imports.append(re.sub(r"\s+", "", found[1]))
            continue
        m = _JAVA_HEAD.match(s.mask, at)
        if not m:
            continue
        body = s.find("{", m.end(), 0)
        if body < 0:
            continue
        end = s.close(body)
        kind = {"@interface": "class"}.get(m["kind"], m["kind"])
        lines, field_calls = [], []
        for a, b, block in s.members(body) if kind != "enum" else ():
            member = s.mask[a:b]
            if re.search(r"(?:^|\s)(?:class|interface|enum|record|@interface)\s+\w+", s.mask[a : block or b]) or re.match(r"(?:static\s*)?\{", member):
                continue
            equals = re.search(r"(?<![=!<>])=(?!=)", s.mask[a : block or b])
            bare = re.sub(r"@[\w.]+(?:\([^()]*\))?", "", s.mask[a : block or b])
            if "(" in bare.split("=")[0]:
                lines.append(f"  {flat(text[a : block if block is not None else b]).rstrip(';').rstrip()};\n")
            elif block is None:
                lines.append(f"  {flat(text[a:b])}\n")
            if equals:
                field_calls.append((a + equals.end(), b))
        head = s.mask[m.end() : body]
        clause = lambda word, stop: re.search(rf"\b{word}\b(.*?)(?=\b(?:{stop})\b|$)", head, re.S)
        extends, implements = clause("extends", "implements|permits"), clause("implements", "permits")
        types = lambda g: re.findall(r"\b[A-Z_$][\w$]*", g[1]) if g else []
        bases, impls = (([], types(extends)) if kind == "interface" else (types(extends), types(implements)))
        calls = []
        for c in _JAVA_CALL.finditer(s.mask, body, end):
            new = c["before"].strip() == "new"
            if c["before"] == "@" or c["name"] in _JAVA_NO_CALL and not new:
                continue
            paren = c.end() - 1
            if not new and s.depth[paren] == 1 and not any(a <= c.start() < b for a, b in field_calls):
                continue  # a method's or constructor's own name
            if not new and re.match(r"\s*(?:throws[\w\s,.]+)?\{", s.mask[s.close(paren) : s.close(paren) + 200]) and re.search(r"[\w>\]]\s+$", s.mask[max(0, c.start() - 80) : c.start()]) and not re.search(r"\b(?:return|else|do|throw)\s+$", s.mask[max(0, c.start() - 80) : c.start()]):
                continue  # a method of an inner type
            calls.append(c["name"])
        decls.append(s.made(kind, m["name"], at, end, f"{flat(text[at:body])} {{\n{''.join(lines)}}}\n", calls=calls, bases=bases, impls=impls))
        done = end
    return decls, imports
