"""Personal data: detection, and keyed surrogates that keep type, script, gender and format.

An entity is a type and a canonical form, so that spellings of one entity share a surrogate (coreference). A surrogate is
drawn by HMAC from key, type, canonical form and the number of the attempt. Collision checks over the whole corpus keep
surrogates distinct from each other and from all entities that occur: an entity that loses draws again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_batches, written

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: What begins with a digit, a bracket or a plus sign.
NUMBERS = re.compile(
    rf"(?<![\w.])(?P<ipv4>{OCTET}(?:\.{OCTET}){{3}})(?!\w|\.[0-9])"
    r"|(?<![\w+])(?P<phone>\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w|\.[0-9])"
    r"|(?<![\w.-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<!\w)(?<![0-9]\.)(?P<card>[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w)"
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
#: Words before a secret.
KEYWORDS = r"token|secret|password|passwd|api[_-]?key|access[_-]?key"
#: A secret is all between quotes (blank lines end it), or all up to white space, a quote or an angle bracket; at least eight characters.
SECRET = re.compile(
    rf"""(?i:\b(?P<word>{KEYWORDS})\b["']?\s*[:=]\s*)"""
    r"""(?:(?P<quote>["'])(?P<inside>(?:(?!(?P=quote))[^\\\n]|\\.|\n(?!\s*\n)){8,})(?P=quote)|["']?(?P<bare>[^\s"'`<>]{8,}))"""
)
#: Titles before a name, and the gender that they tell (fixed values).
TITLES = {
    "Mr.": "m", "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr.": "m", "г-н": "m",
    "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra.": "f", "г-жа": "f",
    "Dr.": "n", "Prof.": "n", "κ.": "m", "κος": "m", "κύριος": "m", "Κύριος": "m", "κα": "f", "κυρία": "f", "Κυρία": "f", "Δρ.": "n",
}
#: Words that stand as titles only behind another title.
STACKED = ["Dr", "Prof", "Professor", "Doktor", "Doctor", "med.", "h.c."]
#: CJK titles stand behind the name, whose first signs are a family name of a fixed list.
CJK_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "博士": "n", "教授": "n"}
CJK_FAMILIES = "欧阳|司马|上官|诸葛|[王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤]"


def _ranges(wanted) -> str:
    """Letters of the basic plane, as the inside of a character class."""
    found = [c for c in range(0x10000) if chr(c).isalpha() and wanted(chr(c))]
    starts = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i == len(found) - 1 or found[i + 1] != c + 1]
    return "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip(starts, ends, strict=True))


_any = lambda words: "|".join(re.escape(t) for t in sorted(words, key=len, reverse=True))
UPPER, BLANK = f"[{_ranges(lambda c: not c.islower())}]", r"[^\S\n]{1,3}"
#: A name's word, with hyphens and with apostrophes that no contraction has; initials; words of low case within a name.
WORD = rf"{UPPER}(?:['’]{UPPER})?[^\W\d_]+(?:-[^\W\d_]+|['’](?:{UPPER}|[^\W\d_]{{3}})[^\W\d_]*)*"
INITIAL = rf"{UPPER}\.(?:-?{UPPER}\.)*"
PARTICLES = "van|von|der|den|ter|de|del|della|di|da|dos|du|la|le|bin|ibn|al|el|zu|zum|zur"
#: Words that begin a sentence or follow a name in title case, and so end it (fixed values).
ENDS = "The|This|That|These|Those|A|An|And|But|Or|If|In|On|At|To|As|By|For|From|With|He|She|It|They|We|You|His|Her|However|When|While|Who|Is|Was|Der|Die|Das|Und|Er|Sie|Es|Le|La|Les|Et|Il|Elle|El|Los|Las"
PERSON = re.compile(
    rf"(?<!\w)(?P<title>{_any(TITLES)})(?P<more>(?:{BLANK}(?:{_any([*TITLES, *STACKED])})(?!\w))*)(?:{BLANK}|[^\S\n]{{0,3}}\n[^\S\n]{{0,8}})"
    rf"(?P<names>(?:{INITIAL}{BLANK}?)*{WORD}(?:{BLANK}(?:(?:{PARTICLES}){BLANK})*(?!(?:{ENDS})(?!\w))(?:{INITIAL}{BLANK}?)*{WORD})*)"
)
CJK_PERSON = re.compile(rf"(?P<family>{CJK_FAMILIES})(?P<given>[\u4e00-\u9fff]{{0,2}}?)(?P<title>{_any(CJK_TITLES)})")
PART = re.compile(rf"{UPPER}(?=\.)|(?:(?!-{UPPER})[\w'’-])+")
LOCAL = re.compile(r"[\w.%+-]+$")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A word in plain letters is no token behind these keywords, though it may be a password.
PLAIN = re.compile(r"[^\W\d_]+(?:[-.,;][^\W\d_]*)*")
HINT = re.compile(rf"[0-9@]|{_any([*TITLES, *CJK_TITLES])}|(?i:{KEYWORDS})")
#: Syllables by script, and endings by gender, of which names are made (fixed values).
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "ga", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "no", "pa", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "to", "va", "vi"],
    "cyrillic": ["ба", "бо", "ва", "ве", "га", "го", "да", "де", "ка", "ко", "ла", "ле", "ли", "ма", "ми", "мо", "на", "не", "но", "па", "ра", "ре", "ро", "са", "се", "та", "те", "то", "фа", "ха", "зо", "ви"],
    "greek": ["βα", "γα", "δα", "δε", "ζα", "θα", "θε", "κα", "κο", "λα", "λε", "λι", "μα", "με", "μι", "μο", "να", "νε", "νι", "νο", "πα", "πε", "ρα", "ρε", "ρι", "σα", "σε", "τα", "τε", "το", "φα", "χα"],
    "cjk": ["安", "白", "宝", "晨", "成", "春", "达", "东", "芳", "峰", "光", "国", "海", "和", "红", "华", "佳", "建", "杰", "静", "军", "兰", "林", "明", "宁", "平", "强", "清", "文", "新", "雪", "玉"],
}
ENDINGS = {"latin": {"m": "n", "f": "a", "n": "l"}, "cyrillic": {"m": "н", "f": "а", "n": "й"}, "greek": {"m": "ς", "f": "α", "n": "ν"}, "cjk": {"m": "刚", "f": "丽", "n": "思"}}
#: After so many attempts the form gives way to distinctness.
STRICT_ATTEMPTS = 24
MOST_ATTEMPTS = 60
CACHE = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "cjk" if 0x3400 <= c < 0xA000 else "latin"


def persons(text: str) -> list[tuple[int, int, str, str]]:
    """Names behind titles (CJK: before), and all other mentions of their parts in the same text, as written or in
    capitals. A part has the type in which the text first has it."""
    named: list[tuple[int, int, str]] = []
    for m in PERSON.finditer(text):
        titles = [m["title"], *m["more"].split()]
        gender = next((g for g in (TITLES.get(t, "n") for t in titles) if g != "n"), "n")
        parts = [x for x in PART.finditer(text, *m.span("names")) if not re.fullmatch(PARTICLES, x.group())]
        named += [(x.start(), x.end(), "family" if x is parts[-1] else f"given_{gender}") for x in parts]
    for m in CJK_PERSON.finditer(text):
        named += [(*m.span(k), kind) for k, kind in (("family", "family"), ("given", f"given_{CJK_TITLES[m['title']]}")) if m[k]]
    if not named:
        return []
    kinds: dict[str, str] = {}
    for b, e, kind in sorted(named):
        kinds.setdefault(text[b:e].casefold(), kind)
    out = [(b, e, kinds[text[b:e].casefold()], text[b:e].casefold()) for b, e, _ in sorted(named)]
    forms = {f for b, e, _ in named if e - b > 1 for f in (text[b:e], text[b:e].upper(), text[b:e].capitalize() if text[b:e].isupper() else text[b:e])}
    cjk = {f for f in forms if script(f) == "cjk"}
    again = [*([rf"(?<!\w)(?:{_any(forms - cjk)})(?!\w)"] if forms - cjk else []), *([_any(cjk)] if cjk else [])]
    if again:
        taken = {b for b, *_ in out}
        for m in re.finditer("|".join(again), text):
            canon = m.group().casefold()
            if m.start() not in taken and canon in kinds:
                out.append((*m.span(), kinds[canon], canon))
    return out


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """Begin, end, type and canonical form of the entities in a text, in order; they don't overlap. A name's parts are
    entities of their own."""
    if not text or not HINT.search(text):
        return []
    found = []
    at = text.find("@")
    while at >= 0:
        left, right, reach = None, DOMAIN.match(text, at + 1), 64
        while right and (left is None or (left.start() == at - reach // 2 and left.start() > 0)):  # look back as far as need be
            left = LOCAL.search(text, max(0, at - reach), at)
            if left is None:
                break
            reach *= 2
        if left and right:
            begin = at - len(text[left.start() : at].lstrip(".-+%"))
            domain = right.group().rstrip(".-")
            if begin < at and "." in domain:
                found.append((begin, at + 1 + len(domain), "email", text[begin : at + 1 + len(domain)].lower()))
        at = text.find("@", at + 1)
    for m in SECRET.finditer(text):
        part = "inside" if m["inside"] else "bare"
        word = part == "bare" and not m["word"].lower().startswith("passw") and PLAIN.fullmatch(m[part])
        if not word and any(c.isalpha() or c.isdigit() for c in m[part]):
            found.append((*m.span(part), "secret", m[part]))
    for m in NUMBERS.finditer(text):
        kind = next(k for k in ("ipv4", "phone", "ssn", "card") if m[k])
        canon = m.group() if kind in ("ipv4", "ssn") else "".join(c for c in m.group() if c.isdigit() or c == "+")
        found.append((*m.span(), kind, canon))
    for m in IBAN.finditer(text):
        canon = m.group().replace(" ", "")
        if int("".join(str(int(c, 36)) for c in canon[4:] + canon[:4])) % 97 == 1:
            found.append((*m.span(), "iban", canon))
    found += persons(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


class Stream:
    """Numbers drawn by HMAC."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.n, self.left = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


def _like(c: str, s: Stream, digits: str = "0123456789", letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    if c.isdigit():
        return digits[s.below(len(digits))]
    if c.isalpha():
        x = letters[s.below(len(letters))]
        return x.upper() if c.isupper() else x
    return c


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The replacement's canonical form: as long as the entity's, but for names and, after many attempts, addresses."""
    s = Stream(key, kind, canon, attempt)
    if kind == "email":
        local, domain = canon.split("@")
        labels = domain.split(".")
        keep = 2 if len(labels) > 2 and labels[-2] == "example" else 1
        d = Stream(key, "domain", domain)  # addresses at one domain stay at one domain
        labels[:-keep] = ["".join(_like(c, d) for c in x) for x in labels[:-keep]]
        head = "".join(_like(c, s) for c in local)
        if attempt >= STRICT_ATTEMPTS:
            head += str(s.below(10**9))
        return f"{head}@{'.'.join(labels)}"
    if kind == "ipv4":
        if attempt >= STRICT_ATTEMPTS:
            return ".".join(str(1 + s.below(254)) for _ in range(4))
        return ".".join(str((1 + s.below(9), 10 + s.below(90), 100 + s.below(155))[len(o) - 1]) for o in canon.split("."))
    if kind == "card":
        body = canon[0] + "".join(str(s.below(10)) for _ in canon[1:-1])
        check = next(d for d in "0123456789" if luhn(body + d))
        if luhn(canon):
            return body + check
        return body + str((int(check) + 1 + s.below(9)) % 10)
    if kind == "phone":
        n = 2 if canon[0] == "+" else 0  # the plus sign and the country code's first digit stay
        rest = "".join(str(s.below(10)) for _ in canon[n + 1 :])
        return canon[:n] + str(2 + s.below(8)) + rest
    if kind == "iban":
        body = "".join(_like(c, s) for c in canon[4:])
        n = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{n:02d}{body}"
    if kind == "secret":
        hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", canon) is not None
        value = "".join(_like(c, s, letters="abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz") for c in canon)
        return value + str(s.below(10**9)) if attempt >= STRICT_ATTEMPTS else value
    if kind == "ssn":
        return "".join(_like(c, s) for c in canon)
    s = Stream(key, "name", canon, attempt)  # a name has one stem, whatever the title before it tells
    own = script(canon)
    syllables = SYLLABLES[own]
    name = "".join(syllables[s.below(len(syllables))] for _ in range((1 if own == "cjk" else 3) + attempt // 4))
    return name + (ENDINGS[own][kind[-1]] if kind.startswith("given") else "")


def render(original: str, kind: str, value: str) -> str:
    """The surrogate in the form that the occurrence has: its separators and its case."""
    if kind in ("family",) or kind.startswith("given"):
        if original.isupper():
            return value.upper() if len(original) > 1 else value[0].upper()
        return value[0].upper() + value[1:]
    if kind in ("phone", "card", "iban"):
        drawn = iter(c for c in value if c != "+")
        return "".join(next(drawn) if c.isalnum() else c for c in original)
    if kind == "email" and original.isupper():
        return value.upper()
    return value


ENTITY = "kind string, canon string"


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """The distinct entities of all texts."""

    def make():
        def step(batch):
            got = sorted({x[2:] for t in batch.column(0).to_pylist() for x in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string()) for i in (0, 1)], ["kind", "canon"])

        return step

    return map_batches(df.select(text), ENTITY, make).distinct()


def spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each occurrence: key, begin and end (code points), kind and canon. Null texts have none."""

    def make():
        def step(batch):
            rows = [(k, *x) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in detect(t)]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [key, "begin", "end", "kind", "canon"])

        return step

    return map_batches(df.select(key, text), f"{key} {df.schema[key].dataType.simpleString()}, begin int, end int, {ENTITY}", make)


def _draw(df: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def make():
        def step(batch):
            drawn = [surrogate(key, k, c, attempt) for k, c in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], ["kind", "canon", "value"])

        return step

    return map_batches(df.select("kind", "canon"), f"{ENTITY}, value string", make)


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canon and value of the entities whose first draw collided. Of entities that draw the same value the least
    canonical form keeps it; none keeps a value that is an entity of the corpus, or that another has already."""
    spark = found.sparkSession
    names = F.when(F.col("kind").startswith("given"), "name").when(F.col("kind") == "family", "name").otherwise(F.col("kind"))
    taken = found.select(names.alias("_space"), F.col("canon").alias("value")).distinct()
    left, kept, late = found, [], []
    for attempt in range(MOST_ATTEMPTS):
        drawn = written(_draw(left, key, attempt).withColumn("_space", names), "drawn")
        free = drawn.join(taken, ["_space", "value"], "left_anti")
        for k in kept:
            free = free.join(k.select("_space", "value"), ["_space", "value"], "left_anti")
        won = written(free.groupBy("_space", "value").agg(F.min(F.struct("canon", "kind")).alias("w")).select("_space", "value", "w.canon", "w.kind"), "won")
        kept.append(won)
        if attempt:
            late.append(won.select("kind", "canon", "value"))
        left = written(drawn.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon"), "left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, late) if late else spark.createDataFrame([], f"{ENTITY}, value string")
    raise RuntimeError("some entities found no surrogate")


def replace(df: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Replace all entities in ``text``; add n_replaced.

    Null texts stay null with none replaced; texts without entities stay as they are. Equal entities get equal surrogates
    in all rows, repeated rows included; rows need no key. Other columns stay, whatever their names; a column that is called
    n_replaced is replaced. What loses a draw is broadcast only if it is small; else each text gets its own exceptions by
    a join on its hash, so that rows behave alike at every size. An empty table gives an empty result.
    """
    columns = [c for c in df.columns if c != "n_replaced"]
    late = written(exceptions(written(entities(df, text), "entities"), key), "exceptions")
    if late.count() <= BROADCAST_ROWS // 10:
        rows = {(r["kind"], r["canon"]): r["value"] for r in late.collect()}
        shared = df.sparkSession.sparkContext.broadcast(rows)
        source, own = df.select(*[F.col(f"`{c}`") for c in columns]), None
    else:
        hashed = df.select(F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"))
        met = spans(hashed, "hash").join(late, ["kind", "canon"]).groupBy("hash").agg(F.collect_set(F.struct("kind", "canon", "value")).alias("late")).withColumnRenamed("hash", "of")
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
        source, own, shared = rows.join(written(met, "late"), F.col("hash") == F.col("of"), "left").select(*[F.col(f"row.`{c}`") for c in columns], F.col("late").alias("_late")), len(columns), None
    place = columns.index(text)

    def make():
        known: dict[tuple[str, str], str] = {}
        fixed = shared.value if shared is not None else {}

        def one(t: str | None, mine: dict) -> tuple[str | None, int]:
            found = detect(t)
            if not found:
                return t, 0
            parts, at = [], 0
            for b, e, kind, canon in found:
                value = mine.get((kind, canon)) or fixed.get((kind, canon)) or known.get((kind, canon))
                if value is None:
                    if len(known) > CACHE:
                        known.clear()
                    value = known[kind, canon] = surrogate(key, kind, canon)
                parts += [t[at:b], render(t[b:e], kind, value)]
                at = e
            return "".join([*parts, t[at:]]), len(found)

        def step(batch) -> Iterator[pa.RecordBatch]:
            late_of = batch.column(own).to_pylist() if own is not None else None
            got = [one(t, {(x["kind"], x["canon"]): x["value"] for x in late_of[i] or []} if late_of else {}) for i, t in enumerate(batch.column(place).to_pylist())]
            cols = list(batch.columns[: len(columns)])
            cols[place] = pa.array([g[0] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[1] for g in got], pa.int64())], [*columns, "n_replaced"])

        return step

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(source, f"{fields}, n_replaced long", make)
