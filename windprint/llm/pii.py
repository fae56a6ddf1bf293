"""Format-preserving pseudonyms for validated numbers, dates and addresses in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8

#: What is looked for. The order matters only where two could start at the same place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9]|-[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])",
}
#: Groups of digits that may hold cards: a run ends before a group where another kind starts. Possessive, so that long runs don't recurse.
KINDS["card"] = (
    r"(?<![0-9A-Za-z-])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])"
    rf"(?:[ -](?!{'|'.join(KINDS[k] for k in ('email', 'ip', 'date', 'ssn'))})[0-9]++(?![A-Za-z]))*+(?!-[0-9])"
)
#: How the digits of a card are grouped, with one separator.
CARD = "^(?:[0-9]{13,19}|" + "|".join(f"[0-9]{{4}}(?:{s}[0-9]{{4}}){{3}}(?:{s}[0-9]{{1,3}})?|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{4,5}}|[0-9]{{4}}(?:{s}[0-9]{{3}}){{3}}" for s in " -") + ")$"
PATTERN = "|".join(KINDS.values())


def luhn(digits: str) -> str:
    """SQL for the Luhn sum modulo 10 of a digit string whose last digit is the check digit."""
    return (
        f"aggregate(sequence(1, length({digits})), 0L, (t, i) -> t + (case when i % 2 = 1 then cast(substring({digits}, length({digits}) - i + 1, 1) as bigint)"
        f" else (cast(substring({digits}, length({digits}) - i + 1, 1) as bigint) * 2) div 10 + (cast(substring({digits}, length({digits}) - i + 1, 1) as bigint) * 2) % 10 end)) % 10"
    )


def _shifted(half: str, other: str, key: str) -> str:
    """SQL: each letter or digit of ``half`` moved within its own alphabet by a keyed hash of ``other``, its length, the round and its place."""
    def moved(base: int, n: int) -> str:
        return f"chr({base} + (ascii(c) - {base} + shift) % {n})"

    return f"""array_join(transform(sequence(1, length({half})), j -> array_join(transform(array(named_struct(
        'c', substring({half}, j, 1),
        'shift', cast(conv(substring(md5(concat_ws(':', {key}, i, j, {other})), 1, 7), 16, 10) as int))), v ->
          case when v.c between '0' and '9' then {moved(48, 10)} when v.c between 'a' and 'z' then {moved(97, 26)}
               when v.c between 'A' and 'Z' then {moved(65, 26)} else v.c end), '')), '')""".replace("ascii(c)", "ascii(v.c)").replace("+ shift)", "+ v.shift)")


def feistel_text(value: str, key: str) -> str:
    """SQL: a keyed permutation of the strings of the shape of ``value`` (which characters are digits, small or capital letters).

    An unbalanced Feistel network over the two halves. A half that is empty changes nothing, so a value of one
    character is moved only by the rounds that shift it against the empty half.
    """
    return f"""aggregate(sequence(1, {ROUNDS}),
        named_struct('l', substring({value}, 1, length({value}) div 2), 'r', substring({value}, length({value}) div 2 + 1)),
        (s, i) -> if(i % 2 = 1, named_struct('l', s.l, 'r', if(length(s.r) = 0, '', {_shifted('s.r', 's.l', key)})),
                                named_struct('l', if(length(s.l) = 0, '', {_shifted('s.l', 's.r', key)}), 'r', s.r)),
        s -> concat(s.l, s.r))"""


def feistel_number(value: str, a: int, b: int, key: str) -> str:
    """SQL: a keyed permutation of the whole numbers 0 to a * b - 1, as a Feistel network on (value div b, value mod b)."""
    def shift(other: str) -> str:
        return f"cast(conv(substring(md5(concat_ws(':', {key}, i, {other})), 1, 12), 16, 10) as bigint)"

    return f"""aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({value} as bigint) div {b}, 'r', cast({value} as bigint) % {b}),
        (s, i) -> if(i % 2 = 1, named_struct('l', (s.l + {shift('s.r')}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {shift('s.l')}) % {b})),
        s -> s.l * {b} + s.r)"""


def _pseudonym(m: str, key: str) -> str:
    """SQL: kind, pseudonym and number of values of a match ``m``; a match that fails its validation has kind null and 0."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    # 1900-01-01 to 2099-12-31 are 73049 = 229 * 319 days
    day = f"datediff(try_to_date({m}, 'yyyy-MM-dd'), date'1900-01-01')"
    new_day = f"date_format(date_add(date'1900-01-01', cast({feistel_number(day, 229, 319, key)} as int)), 'yyyy-MM-dd')"
    octets = f"aggregate(split({m}, '[.]'), 0L, (t, o) -> t * 256 + cast(o as bigint))"
    new_ip = f"element_at(transform(array({feistel_number(octets, 65536, 65536, key)}), n -> concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)), 1)"
    # area 001-899 without 666 (898), group 01-99, serial 0001-9999
    area = f"cast(substring({m}, 1, 3) as bigint)"
    index = f"(({area} - if({area} > 666, 2, 1)) * 99 + cast(substring({m}, 5, 2) as bigint) - 1) * 9999 + cast(substring({m}, 8, 4) as bigint) - 1"
    new_ssn = f"""element_at(transform(array({feistel_number(index, 898, 99 * 9999, key)}), n -> concat_ws('-',
        lpad(cast(n div 989901 + if(n div 989901 + 1 >= 666, 2, 1) as string), 3, '0'), lpad(cast(n div 9999 % 99 + 1 as string), 2, '0'), lpad(cast(n % 9999 + 1 as string), 4, '0'))), 1)"""

    def laid(new: str, m: str = m) -> str:
        """The digits of ``new`` in the places of the digits of the match."""
        return f"""element_at(transform(array({new}), d -> aggregate(sequence(1, length({m})), named_struct('o', '', 'k', 1),
            (s, i) -> if(substring({m}, i, 1) between '0' and '9', named_struct('o', concat(s.o, substring(d, s.k, 1)), 'k', s.k + 1),
                         named_struct('o', concat(s.o, substring({m}, i, 1)), 'k', s.k)), s -> s.o)), 1)"""

    def card(m: str) -> str:
        digits = f"regexp_replace({m}, '[^0-9]', '')"
        body = f"substring({digits}, 1, length({digits}) - 1)"
        return laid(f"element_at(transform(array({feistel_text(body, key)}), b -> concat(b, cast((10 - {luhn('concat(b, ' + chr(39) + '0' + chr(39) + ')')}) % 10 as string))), 1)", m)

    # how many groups of a run form a card from each group on, 0 if none do; then the cards from left to right
    piece = "regexp_replace(array_join(slice(g, i, {k}), ''), '^[ -]', '')"
    groups = f"""transform(sequence(1, size(g)), i -> coalesce(get(filter(sequence(1, 5), k -> exists(array({piece.format(k='k')}),
        c -> c rlike '{CARD}' and exists(array(regexp_replace(c, '[^0-9]', '')), d -> {luhn('d')} = 0))), 0), 0))"""
    walked = f"""aggregate(sequence(1, size(g)), named_struct('o', '', 'n', 0, 'skip', 0), (s, i) ->
        case when s.skip > 0 then named_struct('o', s.o, 'n', s.n, 'skip', s.skip - 1)
             when ks[i - 1] = 0 then named_struct('o', concat(s.o, g[i - 1]), 'n', s.n, 'skip', 0)
             else named_struct('o', concat(s.o, regexp_extract(g[i - 1], '^[ -]?', 0), element_at(transform(array({piece.format(k='ks[i - 1]')}), c -> {card('c')}), 1)),
                               'n', s.n + 1, 'skip', ks[i - 1] - 1) end, s -> named_struct('kind', 'card', 'new', s.o, 'n', s.n))"""
    whole = f"if(length({digits}) between 13 and 19 and {luhn(digits)} = 0, named_struct('kind', 'card', 'new', {card(m)}, 'n', 1), named_struct('kind', cast(null as string), 'new', {m}, 'n', 0))"
    run = f"""element_at(transform(array(regexp_extract_all({m}, '[ -]?[0-9]+', 0)), g -> element_at(transform(array({groups}), ks ->
        if(exists(ks, k -> k > 0), {walked}, {whole})), 1)), 1)"""
    local = f"substring_index({m}, '@', 1)"
    plain = f"regexp_replace({local}, '[^A-Za-z0-9]', '')"
    kept_local = f"""element_at(transform(array({feistel_text(plain, key)}), d -> aggregate(sequence(1, length({local})), named_struct('o', '', 'k', 1),
        (s, i) -> if(substring({local}, i, 1) rlike '[A-Za-z0-9]', named_struct('o', concat(s.o, substring(d, s.k, 1)), 'k', s.k + 1),
                     named_struct('o', concat(s.o, substring({local}, i, 1)), 'k', s.k)), s -> s.o)), 1)"""
    # a phone keeps its leading country digits: the last ten digits are moved, or all but one of fewer
    cut = f"greatest(1, length({digits}) - 10)"
    phone = f"concat(substring({digits}, 1, {cut}), {feistel_text(f'substring({digits}, {cut} + 1)', key)})"

    def made(kind: str, value: str) -> str:
        return f"named_struct('kind', '{kind}', 'new', {value}, 'n', 1)"

    return f"""case
        when {m} like '%@%' then {made('email', f"concat({kept_local}, substring({m}, length({local}) + 1))")}
        when {m} like '+%' then {made('phone', laid(phone))}
        when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {made('ip', new_ip)}
        when {m} rlike '^{KINDS["date"]}$' then if(try_to_date({m}, 'yyyy-MM-dd') is null, named_struct('kind', cast(null as string), 'new', {m}, 'n', 0), {made('date', new_day)})
        when {m} rlike '^{KINDS["ssn"]}$' then {made('ssn', new_ssn)}
        else {run} end"""


def pseudonymise(docs: DataFrame, key: str = "windprint", text_col: str = "text") -> DataFrame:
    """``docs`` with personal numbers, dates and addresses in the text replaced by pseudonyms of the same format.

    Found and validated: e-mail addresses (the local part is moved, letters within letters, digits within digits),
    international phone numbers (the last ten digits), IPv4 addresses (as 32-bit numbers), social security numbers
    (within the valid areas, groups and serials), ISO dates of 1900 to 2099 that the calendar has (within those
    days) and card numbers of 13 to 19 digits that pass the Luhn check (again passing it). Cards are plain digits or
    grouped 4-4-4-4 (and up to three more), 4-6-5, 4-6-4 or 4-3-3-3 with one separator, and are looked for from every group of a
    run of digit groups, so numbers next to a card don't hide it; the run ends before a value of another kind. A run
    without such a card counts as one if all its digits together do, however grouped. Each is a keyed
    permutation within its format, so equal values get equal pseudonyms in all documents, and different ones
    different. The pseudonym of a value depends on the key and the value alone.

    Adds ``new_text``, ``n_replaced`` and ``kinds`` (sorted, distinct), with underscores appended where a name is
    taken. A null text stays null with 0 replaced; texts without such values stay as they are. All rows and columns
    are kept. ``key`` is a literal of the plan: use a secret in production.
    """
    found, new_text, n_replaced, kinds = fresh(docs, "pii_found", "new_text", "n_replaced", "kinds")
    quoted = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    matches = docs.withColumn(found, F.when(F.col(text_col).rlike("[0-9@]"), F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))))
    matches = matches.withColumn(found, F.when(F.size(found) > 0, F.expr(f"transform(`{found}`, m -> {_pseudonym('m', quoted)})")))
    rest = F.split(F.col(text_col), PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(rest, F.col(found), lambda r, m: F.array(r, F.coalesce(m["new"], F.lit(""))))), "")
    used = F.filter(F.transform(F.col(found), lambda m: m["kind"]), lambda k: k.isNotNull())
    return matches.select(
        *docs.columns,
        F.when(F.col(found).isNull(), F.col(text_col)).otherwise(joined).alias(new_text),
        F.when(F.col(found).isNull(), 0).otherwise(F.aggregate(found, F.lit(0), lambda n, m: n + m["n"])).alias(n_replaced),
        F.when(F.col(found).isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(used))).alias(kinds),
    )
