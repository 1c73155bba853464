"""Number formats of spreadsheets: a format code's sections are read once, then show any number of values."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Context, Decimal
from fractions import Fraction
from functools import lru_cache

#: The codes of the formats that workbooks name by number alone.
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 48: "##0.0E+0", 49: "@",
}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

#: A code's parts, and what each is. What a bracket holds is a condition, a time that may exceed its unit, a currency, or
#: something that doesn't show: a colour or a place.
PARTS = re.compile(
    r'"(?P<quoted>[^"]*)"?|\\(?P<escaped>.)|_(?P<gap>.)|\*(?P<fill>.)'
    r"|\[(?P<elapsed>h+|m+|s+)\]|\[(?P<condition>(?:<=|>=|<>|<|>|=)-?[0-9.]+(?:E[+-]?[0-9]+)?)\]|\[\$(?P<currency>[^\]-]*)[^\]]*\]|\[(?P<hidden>[^\]]*)\]"
    r"|(?P<general>General)|(?P<half>AM/PM|A/P)|(?P<seconds>s+(?:\.0+)?)|(?P<date>y+|m+|d+|h+)|(?P<power>E[+-])|(?P<digit>[0#?])|(?P<point>\.)|(?P<comma>,)|(?P<percent>%)|(?P<slash>/)|(?P<text>@)|(?P<literal>.)",
    re.I | re.S,
)
CONDITIONS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}
EXACT = Context(prec=60)


def general(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else f"{value:.15g}"


def exact(value: float) -> Decimal:
    """A number as spreadsheets have it: 15 digits."""
    return Decimal(f"{value:.15g}")


@dataclass
class Section:
    """One section of a code as (kind, what) parts; literals of all kinds are `lit`."""

    parts: list[tuple[str, str]] = field(default_factory=list)
    condition: tuple[str, float] | None = None

    def holds(self, value: float) -> bool:
        return CONDITIONS[self.condition[0]](value, self.condition[1])

    def has(self, *kinds: str) -> bool:
        return any(kind in kinds for kind, _ in self.parts)

    @property
    def below_zero(self) -> bool:
        """Whether all numbers that the condition lets in are negative, so that the section says how that shows."""
        return self.condition is not None and self.condition[0] in ("<", "<=") and self.condition[1] <= 0

    def __post_init__(self):
        """What holds for all numbers is found once."""
        self.is_date = self.has("date", "elapsed", "seconds", "half") and not self.has("digit", "power")
        self.has_date, self.twelve, self.has_power = self.has("date"), self.has("half"), self.has("power")
        self.takes_value, self.has_digit = self.has("general", "text"), self.has("digit")
        self.fraction = fraction_places(self) if self.has("slash") else None
        self.decimals = Decimals(self.parts)
        self.mantissa = Decimals(self.parts[: next(i for i, (kind, _) in enumerate(self.parts) if kind == "power")]) if self.has_power else None
        self.places = max((len(what.partition(".")[2]) for kind, what in self.parts if kind == "seconds"), default=0)
        timed = [i for i, (kind, _) in enumerate(self.parts) if kind in ("date", "seconds", "elapsed")]
        self.minutes = {i for at, i in enumerate(timed) if self._is_minute(timed, at)}

    def _is_minute(self, timed: list[int], at: int) -> bool:
        """An m is a minute right after hours or right before seconds."""
        before = self.parts[timed[at - 1]] if at else ("", "")
        after = self.parts[timed[at + 1]] if at + 1 < len(timed) else ("", "")
        return before[1][:1] in ("h", "H") or after[0] == "seconds" or after[1][:1] in ("s", "S")


def sections_of(code: str) -> list[Section]:
    found: list[tuple[list, list]] = [([], [])]
    for m in PARTS.finditer(code):
        kind, what = m.lastgroup, m[m.lastgroup]
        parts, conditions = found[-1]
        if kind == "literal" and what == ";":
            found.append(([], []))
        elif kind == "condition":
            sign = re.match("[<>=]+", what)[0]
            conditions.append((sign, float(what[len(sign) :])))
        elif kind in ("quoted", "escaped", "currency", "literal"):
            parts.append(("lit", what))
        elif kind == "gap":
            parts.append(("lit", " "))
        elif kind not in ("hidden", "fill"):
            parts.append((kind, what))
    return [Section(parts, conditions[0] if conditions else None) for parts, conditions in found[:4]]


class NumberFormat:
    """A code's sections: for positive numbers, negative ones, zero and text, or those that their conditions let in."""

    def __init__(self, code: str):
        self.sections = sections_of(code)
        self.numbers = self.sections[:3] if len(self.sections) > 3 or not self.sections[-1].has("text") or len(self.sections) == 1 else self.sections[:-1]
        self.conditional = any(s.condition for s in self.numbers)

    def section(self, value: float) -> tuple[Section | None, bool]:
        """The section that shows a number, and whether it shows it without its sign."""
        numbers = self.numbers
        if self.conditional:
            for i, s in enumerate(numbers):
                if s.condition and s.holds(value):
                    return s, s.below_zero
                if not s.condition and (i == len(numbers) - 1 or i == 1 and value < 0):
                    return s, i == 1 and value < 0 and len(numbers) > 2
            return None, False
        if value < 0 and len(numbers) > 1:
            return numbers[1], True
        return numbers[2 if value == 0 and len(numbers) > 2 else 0], False

    def show(self, value: float, epoch_1904: bool = False) -> str:
        section, unsigned = self.section(value)
        if section is None or not section.parts and len(self.sections) == 1:
            return general(value)
        number = abs(value) if unsigned else value
        if section.is_date:
            return shown_date(section, number, epoch_1904)
        if section.takes_value or not section.has_digit:
            whole = "".join(general(number) if kind in ("general", "text") else what if kind in ("lit", "percent", "slash", "point", "comma") else "" for kind, what in section.parts)
            return whole if section.takes_value or number >= 0 else "-" + whole
        sign = "-" if number < 0 else ""
        size = exact(abs(number))
        if section.fraction:
            return sign + shown_fraction(section, size)
        return sign + (shown_power(section, size) if section.has_power else section.decimals.show(size))

    def show_text(self, text: str) -> str:
        """A text as the text section has it; without one, as it is."""
        section = self.sections[3] if len(self.sections) > 3 else next((s for s in self.sections[-1:] if s.has("text")), None)
        return text if section is None else "".join(text if kind == "text" else what if kind == "lit" else "" for kind, what in section.parts)


# -- decimals


def split_at_point(parts: list[tuple[str, str]]) -> tuple[list, list]:
    at = next((i for i, (kind, _) in enumerate(parts) if kind == "point"), len(parts))
    return parts[:at], parts[at:]


def scale_of(parts: list[tuple[str, str]]) -> tuple[list, int, bool]:
    """Parts without commas, the power of ten of percents and scaling commas, and whether thousands are set apart. A comma
    behind the last whole digit divides by a thousand, one between digits groups them."""
    front, back = split_at_point(parts)
    digits = [i for i, (kind, _) in enumerate(front) if kind == "digit"]
    thousands, divide = False, 0
    for i, (kind, _) in enumerate(front):
        if kind == "comma" and digits:
            if i > digits[-1]:
                divide += 1
            elif i > digits[0]:
                thousands = True
    last = max((i for i, (kind, _) in enumerate(back) if kind == "digit"), default=len(back))
    divide += sum(kind == "comma" and i > last for i, (kind, _) in enumerate(back))
    percents = sum(kind == "percent" for kind, _ in parts)
    return [p for p in parts if p[0] != "comma"], 2 * percents - 3 * divide, thousands


def rounded(size: Decimal, places: int, scale: int = 0) -> tuple[str, str]:
    """The digits before the point, none for zero, and `places` digits after it, of a size times a power of ten; halves
    go up."""
    whole = str(int(size.scaleb(places + scale, EXACT).to_integral_value(ROUND_HALF_UP))).rjust(places + 1, "0")
    return whole[: len(whole) - places].lstrip("0"), whole[len(whole) - places :]


def filled(parts: list[tuple[str, str]], whole: str, thousands: bool = False) -> str:
    """A whole number's digits in the places for them, from the right; the first place takes what is left."""
    places = sum(kind == "digit" for kind, _ in parts)
    out, shown, rest = [], 0, whole

    def put(digit: str) -> None:
        nonlocal shown
        if thousands and shown and shown % 3 == 0 and digit != " ":
            out.append(",")
        out.append(digit)
        shown += 1

    for kind, what in reversed(parts):
        if kind == "digit":
            places -= 1
            if rest:
                put(rest[-1])
                rest = rest[:-1]
            elif what != "#":
                put("0" if what == "0" else " ")
            while places == 0 and rest:
                put(rest[-1])
                rest = rest[:-1]
        elif kind in ("lit", "percent", "slash"):
            out.append(what[::-1])
    return "".join(out)[::-1]


class Whole:
    """The places before the point, `filled` where digits stand apart or leave blanks, else put together at once."""

    def __init__(self, parts: list[tuple[str, str]], thousands: bool):
        self.parts, self.thousands = parts, thousands
        at = [i for i, (kind, _) in enumerate(parts) if kind == "digit"]
        self.codes = "".join(parts[i][1] for i in at)
        self.plain = bool(at) and at[-1] - at[0] + 1 == len(at) and "?" not in self.codes
        if self.plain:
            shown = lambda some: "".join(what for kind, what in some if kind in ("lit", "percent", "slash"))
            self.before, self.after = shown(parts[: at[0]]), shown(parts[at[-1] + 1 :])

    def show(self, digits: str) -> str:
        if not self.plain:
            return filled(self.parts, digits, self.thousands)
        if len(digits) < len(self.codes):
            digits = "0" * self.codes.count("0", 0, len(self.codes) - len(digits)) + digits
        if self.thousands and len(digits) > 3:
            first = len(digits) % 3 or 3
            digits = ",".join([digits[:first], *(digits[i : i + 3] for i in range(first, len(digits), 3))])
        return self.before + digits + self.after


class Decimals:
    """A section's parts as they show a number's size in decimals."""

    def __init__(self, parts: list[tuple[str, str]]):
        parts, self.scale, thousands = scale_of(parts)
        front, self.back = split_at_point(parts)
        self.places = [what for kind, what in self.back if kind == "digit"]
        self.whole = Whole(front, thousands)

    def show(self, size: Decimal) -> str:
        places = self.places
        whole, digits = rounded(size, len(places), self.scale)
        if not self.back:
            return self.whole.show(whole)
        kept = len(digits)
        while kept and digits[kept - 1] == "0" and places[kept - 1] != "0":
            kept -= 1
        out, at = [self.whole.show(whole)], 0
        for kind, what in self.back:
            if kind == "digit":
                out.append(digits[at] if at < kept else " " if what == "?" else "")
                at += 1
            else:
                out.append(what)
        return "".join(out)


def shown_power(section: Section, size: Decimal) -> str:
    """Mantissa and exponent; several places before the point make the exponent a multiple of their number."""
    at = next(i for i, (kind, _) in enumerate(section.parts) if kind == "power")
    mantissa, tail = section.parts[:at], section.parts[at + 1 :]
    front, back = split_at_point(mantissa)
    step, places = max(1, sum(k == "digit" for k, _ in front)), sum(k == "digit" for k, _ in back)
    power = 0
    if size:
        power = size.adjusted() // step * step
        if len(rounded(size.scaleb(-power, EXACT), places)[0]) > step:  # rounding has made one digit more
            power += step
    shown = section.mantissa.show(size.scaleb(-power, EXACT))
    sign = "-" if power < 0 else "+" if section.parts[at][1][1] == "+" else ""
    return f"{shown}E{sign}{filled(tail, str(abs(power)).lstrip('0'))}"


# -- fractions


def fraction_places(section: Section) -> tuple[int, int, int, int] | None:
    """Where the numerator begins and ends, and where the denominator does; None if the slash is no fraction's."""
    parts = section.parts
    slash = next(i for i, (kind, _) in enumerate(parts) if kind == "slash")
    begin = slash
    while begin and parts[begin - 1][0] == "digit":
        begin -= 1
    end = slash + 1
    while end < len(parts) and (parts[end][0] == "digit" or parts[end] in [("lit", str(d)) for d in range(10)]):
        end += 1
    return (begin, slash, slash + 1, end) if begin < slash and end > slash + 1 else None


def shown_fraction(section: Section, size: Decimal) -> str:
    """The best fraction with as many digits as the denominator has places (continued fractions find it), or with the
    denominator that the code gives."""
    begin, slash, low, high = section.fraction
    parts = section.parts
    given = "".join(what for _, what in parts[low:high])
    mixed = any(kind == "digit" for kind, _ in parts[:begin])
    over, under = size.as_integer_ratio()
    whole, over = divmod(over, under) if mixed else (0, over)
    most = 10 ** (high - low) - 1
    if given.isdigit() and int(given):
        bottom = int(given)
        top = (over * bottom * 2 + under) // (2 * under)
        if top >= 10**28:
            raise OverflowError
    elif under <= most:
        top, bottom = over, under
    else:
        top, bottom = Fraction(over, under).limit_denominator(most).as_integer_ratio()
    if mixed and top == bottom:
        whole, top = whole + 1, 0
    head = filled([p for p in parts[:begin] if p[0] != "comma"], str(whole) if whole else "" if top else "0") if mixed else "".join(what for _, what in parts[:begin])
    width, tail = slash - begin, "".join(what for kind, what in parts[high:] if kind == "lit")
    if mixed and not top:
        return head + " " * (width + 1 + high - low) + tail
    padded = filled(parts[begin:slash], str(top).lstrip("0") or "0")
    return f"{head}{padded}/{str(bottom).ljust(high - low)}{tail}"


# -- dates and times


def shown_date(section: Section, value: float, epoch_1904: bool) -> str:
    """A day number as date and time; numbers below zero are no days."""
    if value < 0:
        return general(value)
    parts, places = section.parts, section.places
    ticks = int((EXACT.multiply(Decimal(repr(value)), Decimal(86400)).scaleb(places, EXACT)).to_integral_value(ROUND_HALF_UP))
    seconds, fraction = divmod(ticks, 10**places)
    days, second = divmod(seconds, 86400)
    when = datetime.date(1904, 1, 1) if epoch_1904 else datetime.date(1899, 12, 30)
    if section.has_date:
        when += datetime.timedelta(days=days)
    hour, minute, second = second // 3600, second // 60 % 60, second % 60
    twelve = section.twelve
    out = []
    for i, (kind, what) in enumerate(parts):
        if kind == "lit":
            out.append(what)
            continue
        letter, n = what[:1].lower(), len(what)
        pad = lambda x, n=n: str(x).rjust(min(n, 2), "0")
        if kind == "elapsed":
            out.append(str({"h": seconds // 3600, "m": seconds // 60, "s": seconds}[letter]).rjust(n, "0"))
        elif kind == "seconds":
            head, point, tail = what.partition(".")
            out.append(str(second).rjust(min(len(head), 2), "0") + point + (str(fraction).rjust(places, "0")[: len(tail)] if tail else ""))
        elif kind == "half":
            out.append(("AM" if hour < 12 else "PM")[: 2 if n > 3 else 1])
        elif kind == "date" and letter == "h":
            out.append(pad((hour % 12 or 12) if twelve else hour))
        elif kind == "date" and letter == "m" and n < 3 and i in section.minutes:
            out.append(pad(minute))
        elif kind == "date" and letter == "y":
            out.append(f"{when.year:04d}" if n > 2 else f"{when.year % 100:02d}")
        elif kind == "date" and letter == "m":
            name = MONTHS[when.month - 1]
            out.append(pad(when.month) if n < 3 else name[:3] if n == 3 else name[:1] if n == 5 else name)
        elif kind == "date":
            name = DAYS[when.weekday()]
            out.append(pad(when.day) if n < 3 else name[:3] if n == 3 else name)
        elif kind != "text":
            out.append(what)
    return "".join(out)


@lru_cache(4096)
def number_format(code: str) -> NumberFormat:
    return NumberFormat(code)


def shown_number(value: float, code: str | None, epoch_1904: bool = False) -> str:
    """A number as its format code shows it. Without a code, for one that is no code, and for numbers that a code can't
    show (days beyond the calendar), the number itself."""
    if not code or code.lower() == "general" or code == "@":
        return general(value)
    try:
        return number_format(code).show(value, epoch_1904)
    except (ValueError, OverflowError, ArithmeticError, StopIteration):
        return general(value)


def shown_text(text: str, code: str | None) -> str:
    return text if not code or code == "@" or "@" not in code else number_format(code).show_text(text)
