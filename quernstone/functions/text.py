"""Scalar text functions as column expressions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decompose into a base letter and a mark, and the ones that need a rule of their own.
ACCENTED = "ąćęłńóśźżàâäáãåçéèêëíìîïñôöòõúùûüýÿ"
PLAIN = "acelnoszzaaaaaaceeeeiiiinooooouuuuyy"
#: Fixed values.
SUPERSCRIPTS = "¹²³⁰⁴⁵⁶⁷⁸⁹"
#: Signs of Roman numerals, Polish months, ordinal and structural words, bullets and dashes.
LETTERS = r"\p{L}"
ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
MONTHS = ["stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia"]
ORDINAL_WORDS = ["pierwsza", "druga", "trzecia", "czwarta", "piąta", "szósta", "siódma", "ósma", "dziewiąta", "dziesiąta", "ogólna", "szczególna", "wojskowa"]
STRUCTURAL = {"KSIĘGA": "book", "CZĘŚĆ": "part", "DZIAŁ": "division", "ROZDZIAŁ": "chapter", "ODDZIAŁ": "subchapter"}
BULLETS = ["•", "▪", "◦", "‣", "*", "●", "■", "□", "○", "✓", "✔", "\uf0b7", "\uf0a7", "\uf0d8", "\uf076", "\uf0fc", "\uf06e", "\uf0a8"]
DASHES = ["–", "—", "-"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once and not once a mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fingerprint(c: Column) -> Column:
    """Lower case, digit runs as #, white space collapsed, edges cut to a letter or #."""
    return F.regexp_replace(squeeze(F.regexp_replace(F.lower(c), r"\p{Nd}+", "#")), r"^[^\p{L}#]+|[^\p{L}#]+$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def roman_value(c: Column) -> Column:
    """Sum of the signs, those before a larger one taken off. Says nothing of the form: see is_roman."""
    value = F.create_map(*[F.lit(x) for v, sign in ROMAN if len(sign) == 1 for x in (sign, v)])
    signs = F.transform(F.split(F.lower(c), ""), lambda x: F.coalesce(F.element_at(value, x), F.lit(0)))
    signed = F.zip_with(signs, F.slice(signs, 2, 100), lambda x, after: F.when(x < after, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0), lambda total, x: total + x)


def is_roman(c: Column, most: int = 3999) -> Column:
    """Whether a numeral is well formed: it is what its value is written as."""
    written = lambda n: n.between(1, most) & (to_roman(n) == F.lower(c))
    return c.rlike("(?i)^[ivxlcdm]{1,15}$") & _let(roman_value(c), written)


def to_roman(n: Column) -> Column:
    """Lower-case Roman numeral of a positive number under 4000."""
    parts, left = [], n.cast("int")
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), (left / value).cast("int")))
        left = left % value
    return F.concat(*parts)


#: No page mark is longer.
MARK_CHARS = 200
#: What is left of a page mark when # stands for its numbers, and how many digits the first may have.
PAGE_MARKS = {"#": 3, "-#-": 4, "#/#": 4, "strona #": 4, "strona # z #": 4, "str.#": 4, "s.#": 4, "s.#/#": 4}


def page_number(c: Column) -> Column:
    """Number of a lone page mark, null where the text isn't one."""
    marks = F.create_map(*[F.lit(x) for kv in PAGE_MARKS.items() for x in kv])

    def number(t: Column) -> Column:
        mark = F.regexp_replace(F.translate(F.lower(t), "–—", "--"), r"\s*([-/.])\s*", "$1")
        mark = F.regexp_replace(F.regexp_replace(mark, r"\s+", " "), r"[0-9]+", "#")
        runs = F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))
        fits = lambda r: F.when((F.length(F.get(r, F.lit(0))) <= F.element_at(marks, mark)) & F.forall(r, lambda x: F.length(x) <= 4), F.get(r, F.lit(0)).cast("int"))
        return F.when(F.length(t) <= MARK_CHARS, F.coalesce(_let(runs, fits), F.when(is_roman(t), roman_value(t))))

    return _let(F.trim(c), number)


def page_of_total(c: Column) -> tuple[Column, Column]:
    """(n, m) of "n / m"."""
    p = r"^(\d{1,3})\s*/\s*(\d{1,3})$"
    return tuple(F.when(F.trim(c).rlike(p), F.regexp_extract(F.trim(c), p, g).cast("int")) for g in (1, 2))


def hyphen_join(end: Column, following: Column, exceptions: list[str] = []) -> Column:
    """NONE, REMOVE or KEEP for the hyphen at a line's end."""
    e, n = F.rtrim(end), F.ltrim(following)
    last = F.regexp_extract(e, r"([^ ]*)$", 1)
    web = e.rlike(r".-$") & (n != "") & (F.contains(last, F.lit("/")) | F.contains(last, F.lit("www.")))
    prefix = F.regexp_extract(e, r"(\p{L}+)-$", 1)
    word = F.regexp_extract(n, r"^(\p{L}+)", 1)
    listed = F.lower(F.concat(prefix, F.lit("-"), word)).isin([x.lower() for x in exceptions]) if exceptions else F.lit(False)
    keep = listed | n.rlike(r"^\p{Lu}") | (F.length(prefix) == 1) | prefix.rlike(r"^\p{Lu}{1,4}$")
    return F.when(web, "KEEP").when((prefix == "") | (word == ""), "NONE").when(keep, "KEEP").otherwise("REMOVE")


def _is_unit_number(c: Column) -> Column:
    """Digits, up to three letters, superscripts."""
    plain = F.regexp_replace(c, f"[{SUPERSCRIPTS}]+$", "")
    letters = F.ltrim(F.translate(plain, "0123456789", ""))
    return plain.rlike("^[0-9]") & plain.endswith(letters) & letters.rlike("^[a-z]{0,3}$")


def _numerals(c: Column) -> tuple[Column, Column]:
    """(Roman of up to seven signs, up to four digits), each with a letter after it or not."""
    base = F.when(F.length(c) > 1, F.regexp_replace(c, "[a-z]$", "")).otherwise(c)
    made_of = lambda signs, most: F.length(base).between(1, most) & (F.translate(base, signs, "") == "")
    return made_of("IVXLC", 7), made_of("0123456789", 4)


def legal_unit(c: Column) -> Column:
    """struct(kind, designation, number, rest, prefix), null where the line opens no unit.

    The line is cut into an opening bracket, a sign or word, the token after it and the rest; each is tested on its own.
    """
    without_dot = lambda x: F.regexp_replace(F.trim(x), r"^\.\s*", "")
    made = lambda kind, head, number, rest, prefix: F.struct(kind.alias("kind"), F.concat(head, F.lit(" "), number).alias("designation"), number.alias("number"), without_dot(rest).alias("rest"), prefix.alias("prefix"))
    kinds = {form: kind for name, kind in STRUCTURAL.items() for form in (name, name.capitalize())}
    kind_of = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])

    def unit(u: Column, prefix: Column) -> Column:
        def by_sign(sign: Column) -> Column:
            def by_token(after: Column, token: Column) -> Column:
                tail = F.trim(F.substr(after, F.length(token) + 1))
                dotted = token.endswith(".")
                whole_line = (sign == "§") & (tail == "") & (prefix == "")
                number = F.when(dotted, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)
                kind = F.when(sign == "§", "paragraph").otherwise("article")
                return _let(number, lambda n: F.when(_is_unit_number(n) & (dotted | whole_line), made(kind, sign, n, tail, prefix)))

            after = F.ltrim(F.regexp_replace(F.substr(u, F.length(sign) + 1), r"^\s+", ""))
            return _let(after, lambda x: _let(F.regexp_extract(x, r"^\S+", 0), lambda token: by_token(x, token)))

        sign = F.when(u.startswith("Art."), "Art.").when(u.startswith("§"), "§")
        return F.when(sign.isNotNull(), _let(sign, by_sign))

    def part(t: Column, word: Column) -> Column:
        kind = F.element_at(kind_of, word)
        behind = F.trim(F.substr(t, F.length(word) + 1))

        def by_numeral(numeral: Column) -> Column:
            left = F.substr(behind, F.length(numeral) + 1)
            roman, arabic = _numerals(numeral)
            named = F.when(kind.isin("book", "part"), roman | F.lower(numeral).isin(ORDINAL_WORDS)).otherwise(roman | arabic)
            return F.when(named & left.rlike(r"^(\s|\.|$)"), made(kind, word, numeral, left, F.lit("")))

        return F.when(kind.isNotNull(), _let(F.regexp_extract(behind, r"^[\p{L}0-9]+", 0), by_numeral))

    def line(t: Column) -> Column:
        bracket = F.when((F.length(t) > 1) & F.substring(t, 1, 1).isin("[", "<"), F.substring(t, 1, 1)).otherwise("")
        by_bracket = lambda prefix: F.coalesce(_let(F.substr(t, F.length(prefix) + 1), lambda u: unit(u, prefix)), F.when(prefix == "", _let(F.regexp_extract(t, r"^\S+", 0), lambda word: part(t, word))))
        return _let(bracket, by_bracket)

    return _let(F.trim(c), line)


def letter_ordinal(c: Column) -> Column:
    """a = 1 ... z = 26, aa = 27."""
    one = lambda i: F.ascii(F.substring(c, i, 1)) - 96
    return F.when(F.length(c) == 1, one(1)).otherwise(one(2) + 26 * one(1))


def list_label(c: Column) -> Column:
    """struct(label, kind, ordinal, rest) of a list line, null where it has no label or no text after it.

    The first token is cut into an opening bracket, a body and a closing sign; the closing sign says which bodies can be.
    """
    to = lambda kind, ordinal: F.struct(F.lit(kind).alias("kind"), ordinal.cast("int").alias("ordinal"))

    def by_body(body: Column, closing: Column) -> Column:
        digits = F.regexp_extract(body, "^[0-9]+", 0)
        suffix = F.substr(body, F.length(digits) + 1)
        is_number = F.length(digits).between(1, 3)
        raised = F.translate(suffix, SUPERSCRIPTS, "") == ""
        letters = F.regexp_replace(body, f"[{SUPERSCRIPTS}]+$", "")
        roman = is_roman(body, 39)
        upper_roman, lower_roman = (F.upper(body) == body) & roman, (F.lower(body) == body) & (F.length(body) > 1) & roman
        closed = (
            F.when(is_number & (raised | suffix.rlike("^[a-z]{1,2}$")), F.struct(F.when(closing == ")", "arabicParen").otherwise("arabicDot").alias("kind"), digits.cast("int").alias("ordinal")))
            .when(upper_roman, to("roman", roman_value(body))).when(lower_roman & (closing == ")"), to("roman", roman_value(body)))
            .when(letters.rlike("^[a-z]{1,2}$") & (closing == ")"), to("letterParen", letter_ordinal(letters))).when(body.rlike("^[a-z]$") & (closing == "."), to("letterDot", letter_ordinal(body)))
            .when(lower_roman, to("romanDot", roman_value(body)))
        )
        slashed = F.when(is_number & suffix.rlike("^[a-z]?$"), to("arabicSlash", digits)).when(body.rlike("^[a-z]{1,2}$"), to("letterSlash", letter_ordinal(body)))
        return F.when(closing.isin(")", "."), closed).when(closing == "/", slashed)

    def kind_of(x: Column) -> Column:
        steps = F.split(F.regexp_replace(x, r"\.$", ""), r"\.")
        outline = (F.size(steps) > 1) & F.forall(steps, lambda s: s.rlike("^[0-9]{1,3}$"))
        closing = F.when(x.rlike(r"[)./]$"), F.substring(x, -1, 1)).otherwise("")
        body = F.substring(x, F.lit(1), F.length(x) - F.length(closing))
        signs = F.when(x.isin(BULLETS), to("bullet", F.lit(None))).when(x.isin(DASHES), to("dash", F.lit(None))).when(outline, to("outline", F.lit(None)))
        return F.coalesce(signs, F.when(closing != "", _let(body, lambda y: by_body(y, closing))))

    def labelled(t: Column, label: Column) -> Column:
        rest = F.trim(F.regexp_replace(F.substr(t, F.length(label) + 1), r"^\s+", ""))
        bracketed = (F.length(label) > 1) & F.substring(label, 1, 1).isin("[", "<")

        def settled(found: Column) -> Column:
            barred = bracketed & found["kind"].isin("bullet", "dash", "letterDot", "romanDot")
            return F.when((rest != "") & found.isNotNull() & ~barred, F.struct(label.alias("label"), found["kind"].alias("kind"), found["ordinal"].alias("ordinal"), rest.alias("rest")))

        return F.when(label != "", _let(_let(F.when(bracketed, F.substr(label, F.lit(2))).otherwise(label), kind_of), settled))

    return _let(F.trim(c), lambda t: _let(F.regexp_extract(t, r"^\S+", 0), lambda label: labelled(t, label)))


def unit_normal(c: Column) -> Column:
    """Form in which units are compared: lower, white space collapsed, no final dot."""
    return F.rtrim(F.regexp_replace(squeeze(F.lower(c)), r"\.$", ""))


def unit_matches(cited: Column, unit: Column) -> Column:
    """Whether the cited text starts with the unit, or with the unit's leading number, at a boundary."""
    c, u = unit_normal(cited), unit_normal(unit)
    starts = lambda p: (p != "") & F.startswith(c, p) & ((F.length(c) == F.length(p)) | F.substr(c, F.length(p) + 1, F.lit(1)).isin(" ", ","))
    return starts(u) | starts(F.regexp_extract(u, r"^(\d+(?:\.\d+)*)\. ", 1))


def grounding_normal(c: Column) -> Column:
    """Comments dropped, lower case, every run of other characters than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?s)<!--.*?-->", " ")), r"[^\p{L}\p{Nd}]+", " "))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1))


def without_list_labels(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}])((\d{1,2}|\p{L})\\?\)|(\d{1,3}\p{Ll}?|\p{Ll}{1,2})/|(\p{Ll}|[ivx]{2,6})\\?\.(?=\s))", " ")


def question_normal(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(squeeze(F.lower(c)), r"[? ]+$", ""))


def token_estimate(c: Column, chars_per_token: float = 3.0) -> Column:
    return F.least(F.ceil(F.length(c) / F.lit(chars_per_token)), F.lit(2147483647)).cast("int")


def fold(c: Column) -> Column:
    """Lower, white space collapsed, letters without their marks."""
    return F.translate(squeeze(F.lower(c)), ACCENTED, PLAIN)


def has_word(c: Column, word: Column) -> Column:
    """Whether the word stands in the text unattached to letters or digits."""
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), F.lit(" ")), F.concat(F.lit(" "), word, F.lit(" ")))


def polish_amount(c: Column, unit: str = "zł") -> Column:
    return F.concat(F.translate(F.format_number(c, 2), ",.", " ,"), F.lit(f" {unit}"))


def polish_date(c: Column) -> Column:
    return F.concat(F.dayofmonth(c), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(c)), F.lit(" "), F.year(c), F.lit(" r."))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    return F.when(n == 1, one).when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), few).otherwise(many)


def font_family(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"^[A-Z]{6}\+", ""), r"^([^-,]*)", 1)


def font_style(c: Column) -> tuple[Column, Column]:
    """(bold, italic) from the tokens of a font name."""
    low = F.lower(c)
    return low.rlike("bold|black|heavy|semibold|demi"), low.rlike("italic|oblique|slanted|kursiv")


def without_version(c: Column) -> Column:
    return F.regexp_replace(c, r"-w\d+$", "")


def unit_label(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"\.$", "")
    return F.when(bare.rlike(r"^(\d+|[IVXLC]+)$"), F.concat(F.lit("sekcja "), bare)).otherwise(bare)


def escape_markdown(c: Column, at_line_start: bool = False, in_table: bool = False) -> Column:
    out = F.regexp_replace(c, r"([\\*_\[\]<>`" + ("|" if in_table else "") + "])", r"\\$1")
    if at_line_start:
        out = F.regexp_replace(F.regexp_replace(out, r"^([#+\-=])", r"\\$1"), r"^(\d+)([.)])", r"$1\\$2")
    return out


def escape_label(c: Column) -> Column:
    cut = c.rlike(r"[).]$")
    return F.when(cut, F.concat(escape_markdown(F.regexp_replace(c, r".$", "")), F.lit("\\"), F.right(c, F.lit(1)))).otherwise(escape_markdown(c))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s", "-"), r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}-]", "")


def heading_inline(c: Column) -> Column:
    """The rendered text of a heading: emphasis stars removed, backslash escapes resolved."""
    plain = F.replace(F.replace(c, F.lit("\\*"), F.lit("\0")), F.lit("*"), F.lit(""))
    return F.replace(F.regexp_replace(plain, r"\\([!-/:-@\[-`{-~])", "$1"), F.lit("\0"), F.lit("*"))


def yaml_quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(squeeze(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def redacted(c: Column, secrets: list[str]) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("***")), secrets, c)


def tidy_periods(c: Column) -> Column:
    """Double periods to one, ellipses stay."""
    return F.regexp_replace(c, r"(?<!\.)\.\.(?!\.)", ".")


def file_stem(url: Column, limit: int = 120) -> Column:
    """Safe file stem of the last path segment of a URL."""
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*(?:/.*)?/([^/]*)$", 1)
    plain = F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B")))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r'[<>:"/\\|?*\x00-\x1F]+', "-"), r"\.[A-Za-z0-9]{1,5}$", ""), r"^[-. ]+|[-. ]+$", "")
    reserved = F.upper(safe).rlike(r"^(CON|PRN|AUX|NUL|COM\d|LPT\d)$")
    return F.left(F.when(reserved, F.concat(F.lit("_"), safe)).when(safe == "", "document").otherwise(safe), F.lit(limit))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_allowed(url: Column, allowed: list[str]) -> Column:
    h = host_of(url)
    return reduce(lambda a, b: a | b, [(h == a.lower()) | h.endswith("." + a.lower()) for a in allowed])


def address_problem(url: Column, allowed: list[str], repeated: Column) -> Column:
    """First failing check of an address, null where all pass."""
    u = F.trim(url)
    return (
        F.when(u.isNull() | (u == ""), "empty").when(~u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), "not-absolute").when(~F.lower(u).rlike("^https?://"), "scheme")
        .when(u.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "user-info").when(~host_allowed(u, allowed), "host").when(repeated, "duplicate")
    )
