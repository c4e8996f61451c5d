"""Problem 8: personal information inside free text.

Seeds are known entities: names whose parts are listed (those whose family name alone is count half), e-mail addresses of persons with a listed family name,
international phone numbers, numbers behind a word for an identity document, and streets with a word for a street. Every
occurrence of anything that has an entity's form is a candidate, with its key (what it shares with other candidates: the
family name, the street, the domain, the form of the number) and its contexts: the text before and behind it and, of a person, the
given name. Keys and contexts are the two sides of a graph that Spark scores in rounds: contexts in which enough keys are
known become patterns, keys that mostly stand in patterns become known. Candidates with a known key are the result; of
identity numbers, whose forms other numbers share, those in a pattern, and those with letters whose key is well known.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.encode import few_rows_a_batch
from weftline.shared import settled

KINDS = ("email", "phone", "id_number", "address", "person")
#: Words that stand before the number of an identity document, and words of which a street's name has one.
ID_WORDS = ("passport", "passport no", "ssn", "national id", "tax id", "identity card", "id no", "ausweis", "carte d'identité", "carte d’identité", "steuer", "dni", "nif", "social security")
STREET_WORDS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "drive", "blvd", "boulevard", "court", "quay", "way", "rue", "impasse", "chemin", "allée", "place", "quai", "calle", "avenida", "paseo", "plaza", "camino", "straße", "strasse", "allee", "platz")
STREET_ENDS = ("straße", "strasse", "gasse", "weg", "platz", "allee")


def _gaps(pattern: str) -> str:
    """A pattern in which each space may be a no-break space, too."""
    return pattern.replace(" ", "[ \\xa0]")


_HEAD = r"[^\W\d_a-zß-öø-ÿ]"
_REST = rf"[\w'’]*(?:-{_HEAD}[\w'’]*)*"
_CAP = _HEAD + _REST
#: Words in small letters between a given and a family name.
_LINK = r"(?:(?:van|von|vom|zu|zur|de|del|della|der|den|di|da|do|dos|das|du|des|la|las|los|le|el|al|bin|ibn|ben|ter|ten|y) ){0,3}"
# Patterns begin with the letters they may begin with and look back behind them, which lets the search skip all others; what follows is looked at without being taken, as names may overlap.
_NAME = re.compile(_gaps(rf"{_HEAD}(?<![\w.@-].)(?:(?=((?:{_REST}|(?<=[A-Z])\.)) (?:[A-Z]\. )?{_LINK}({_CAP})(?![\w@]))|(?=({_REST}), ({_CAP}|[A-Z]\.(?!\w))(?: [A-Z]\.)?(?![\w@])))"), re.S)
_INITIAL = re.compile(_gaps(r" [A-Z]\.(?![\w@])"))
_SECOND = re.compile(_gaps(rf" ({_CAP})(?![\w@])"))
_LABEL = re.compile(rf"(?:{'|'.join(ID_WORDS)})(?:nummer|-nr)?[\s:.]*$".replace(" ", r"\s?"))
_LEADS = re.compile(_gaps(rf"(?<![\w.@-]){_CAP} (?:[A-Z]\. )?$"))
_AT = re.compile(r"@| ?[\[(](?:at|AT|@)[\])] ?| AT | at (?=[\w-]+ (?:dot|DOT) )")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?| dot | DOT )[\w-]+)+")
_DOT = re.compile(r" ?[\[(](?:dot|DOT)[\])] ?| dot | DOT ")
_NUMBER = re.compile(r"(?<![\w.+/@-])(?:(?<!\()|(?=\())(?:[A-Z]{1,2})?\+?\(?\d{1,11}(?:[A-Z](?=\d))?\)?(?:(?: / |/(?=\d{4})|\)? ?\(|[- .\xa0  ‑](?=[\d(])|(?<=\))(?=\d)|(?<=[A-Z])(?=\d))\d{1,10}\)?){0,6}(?:-?[A-Z])?(?![\w@]|[-.]\d)")
_PARTICLE = r"(?:de|del|de la|de las|de los|la|las|los|du|des|le|les|der|den|dem|am|an|auf|zum|zur|von|rue|impasse|avenue|allée|chemin|place|quai|boulevard|cours|passage|calle|plaza)"
_WORD = r"(?:[dl]['’])?[^\W\d_a-zß-öø-ÿ][\w'’-]*\.?"
_BY_NUMBER = re.compile(_gaps(rf"\d(?<![\w.,/-].)(?=\d{{0,4}}(?: ?[a-h](?![\w.])|[A-H](?!\w))?(?: bis| ter)?,? ((?:(?:{_WORD}|{_PARTICLE}) ){{0,5}}{_WORD})(?!\w))"), re.S)
_TAIL = rf"(?: (?:{_PARTICLE}|{_WORD})){{0,5}}),? (?:n\.?[º°o]\.? ?|no\. )?\d{{1,4}}(?: ?[a-h](?!\w))?)(?![\w.:/%-])"
_BY_STREET = re.compile(_gaps(rf"{_HEAD}(?<![\w/-].)(?=(([\w'’-]*\.?{_TAIL})"), re.S)
_SMALL = re.compile(_gaps(r"(?:c(?=alle )|r(?=u[ea] )|a(?=venue |l\. )|u(?=l\. )|v(?=ia )|[dl](?=['’]))(?<![\w/-].)"), re.S)
_BY_SMALL = re.compile(_gaps(rf"(((?:{_WORD}|calle|rue|avenue|ul\.|al\.|via|rua){_TAIL}"))
_FIVE, _DIGIT = re.compile(r"\d{5}"), re.compile(r"\d")
_LINE = re.compile(r'^[\s",\[\]#>*]+')
_SPACE = re.compile(r"\s+")


def fold(word: str) -> str:
    """A word in ASCII lower-case letters, as in addresses."""
    w = word.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l")
    return re.sub(r"[^a-z]", "", unicodedata.normalize("NFKD", w))


def before(text: str, at: int) -> str:
    s = text[max(0, at - 32) : at].replace('\\"', '"').replace("\\n", "\n").replace("\\r", "").replace("\r", "")
    line = s.rfind("\n")
    if line >= 0:
        s = "⏎" + _LINE.sub("", s[line + 1 :])
    return re.sub(r"\d+", "9", _SPACE.sub(" ", s))[-12:]


def behind(text: str, at: int) -> str:
    s = text[at : at + 12].replace('\\"', '"').replace("\\n", "\n").replace("\r", "").replace("\\r", "")
    return re.sub(r"\d+", "9", _SPACE.sub(" ", s.replace("\n", "⏎")))[:3]


def shape(number: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", _SPACE.sub(" ", number.replace("\u2011", "-"))))


def _street_places(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, begin, end) of all that may be a street with a house number."""
    for m in _BY_NUMBER.finditer(text):
        yield m.group(1), m.start(), m.end(1)
    for m in _BY_STREET.finditer(text):
        yield text[m.start() : m.end(2)], m.start(), m.end(1)
    for at in _SMALL.finditer(text):
        if m := _BY_SMALL.match(text, at.start()):
            yield m.group(2), m.start(), m.end(1)


def candidates(text: str) -> Iterator[tuple[str, str, str, str, int, int]]:
    """(kind, text, key, hint for the seeds, begin, end) of everything that has an entity's form."""
    for m in _NAME.finditer(text):
        a = m.start()
        if m.group(1) is None or m.end(1) == a + 2 and text[a + 1] == ".":
            if _LEADS.search(text, max(0, a - 40), a):
                continue  # the middle of a longer name
        if m.group(1) is not None:
            given, b = fold(text[a : m.end(1)]), m.end(2)
            yield "person", text[a:b], fold(m.group(2)), given, a, b
            if more := _SECOND.match(text, b):
                yield "double", text[a : more.end()], f"{fold(m.group(2))} {fold(more.group(1))}", given, a, more.end()
        else:
            b = m.end(4)
            initial = _INITIAL.match(text, b)
            b = initial.end() if initial else b
            yield "person", text[a:b], fold(text[a : m.end(3)]), fold(m.group(4)), a, b
    for m in _AT.finditer(text):
        a, right = m.start(), _DOMAIN.match(text, m.end())
        while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):
            a -= 1
        if a < m.start() and right:
            b = right.end()
            domain = _DOT.sub(".", right.group()).rstrip(".-").lower()
            if domain.rpartition(".")[2].isalpha():
                yield "email", text[a:b].rstrip(".-"), domain, re.sub(r"\d|\+.*", "", text[a : m.start()]), a, b
    for m in _NUMBER.finditer(text):
        s, a = m.group(), m.start()
        if len(s) < 6:
            continue
        if s[0] == "(" and s[-1] == ")" and s.count(")") == 1:
            s, a = s[1:-1], a + 1
        elif s[-1] == ")" and s.count(")") > s.count("("):
            s = s[:-1]
        b = a + len(s)
        digits = len(_DIGIT.findall(s))
        if digits < 6 or digits > 15 or len(s) - digits == 1 and "." in s:
            continue
        form, head = shape(s), text[max(0, a - 28) : a].lower()
        if digits >= 7 and "A" not in form:
            yield "phone", s, form, "+" if s[0] == "+" and digits > 8 else "", a, b
        if s[0] not in "+(":
            yield "id_number", s, form, "+" if _LABEL.search(head) else "", a, b
    for name, a, b in _street_places(text):
        name = _SPACE.sub(" ", name).rstrip(" ,")
        if name.isupper() and name.count(" ") > 2:
            continue  # a line in capitals, not a street
        name = name.lower()
        words = re.split(r"[\s.]+", name)
        known = any(w in STREET_WORDS or w.endswith(STREET_ENDS) and w not in STREET_ENDS for w in words)
        if not known and _FIVE.match(text, a):
            continue  # more likely a postcode and its town
        yield "address", text[a:b], name, "+" if known else "", a, b


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "pii_text", "key", "hint", "near", "wide", "doc_id", "begin_at"]
    types = [pa.string()] * 6 + [pa.int64(), pa.int32()]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            out = []
            for doc, text in zip(batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200).to_pylist()):
                for kind, s, key, hint, a, b in candidates(text):
                    left = before(text, a) if kind != "double" else None  # that has no contexts of its own
                    out.append((kind, s, key, hint, left and left[-5:] + "|" + behind(text, a + len(s)), left, doc, a))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(w) for w in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["part", "k"])


def find_personal(documents: DataFrame, name_parts: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 8, support: int = 2) -> DataFrame:
    """Occurrences (doc_id, kind, pii_text, begin_at, end_at) in code points, 0-based, end exclusive.

    Null and empty texts have none. Rows with a null id aren't searched; every other row of documents is, as it stands; a
    repeated row repeats its occurrences.
    Null name parts and kinds are ignored, their case doesn't matter. Without name parts, persons and e-mail addresses have
    no seeds and none are found.

    support: strings with a known key that a context must have had to be a pattern. At first their share must be half of what is
    usual in the contexts of the seeds (the median over the seeds' places), or a fifth where that is less: lists that leave
    out many names lower the share everywhere. Later it must be half of all. rounds: at most; they end when nothing changes.
    """
    docs = documents.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with few_rows_a_batch(documents.sparkSession):
        found = settled(docs.mapInArrow(_scan, "kind string, pii_text string, key string, hint string, near string, wide string, doc_id bigint, begin_at int"), "candidates")
    parts = settled(name_parts.filter("name_part IS NOT NULL AND kind IS NOT NULL").select("name_part", F.lower("kind").alias("k")).mapInArrow(_folded, "part string, k string").distinct(), "names")
    family, given = parts.filter("k = 'family'").select("part"), parts.filter("k = 'given'").select("part")
    double, found = found.filter("kind = 'double'"), found.filter("kind <> 'double'")
    by = found.groupBy("kind", "key", "hint").agg(F.count(F.lit(1)).alias("n"))
    listed = by.filter("kind = 'person'").join(family.withColumnRenamed("part", "key"), "key", "left_semi")
    own = listed.join(given.withColumnRenamed("part", "hint"), "hint", "left_semi")
    half = listed.filter(F.length("hint") > 1)  # a listed family name behind another word than a listed given name counts half
    mail = by.filter("kind = 'email'").withColumn("word", F.explode(F.split(F.lower("hint"), r"[._-]+"))).join(family.withColumnRenamed("part", "word"), "word", "left_semi")
    sure = own.select("kind", "key").unionByName(mail.select("kind", "key")).unionByName(by.filter("hint = '+' AND kind IN ('phone', 'id_number', 'address')").select("kind", "key"))
    seeds = sure.withColumn("score", F.lit(1.0)).unionByName(half.select("kind", "key", F.lit(0.5).alias("score"))).groupBy("kind", "key").agg(F.max("score").alias("score"))
    # The graph: how many different strings with each key stand in each context. Contexts of an occurrence: a narrow one of both sides, a wide one of the left, a person's given name.
    given_name = F.when((F.col("kind") == "person") & (F.length("hint") > 1), F.concat(F.lit("g"), "hint"))
    contexts = F.array_compact(F.array(F.concat(F.lit("n"), "near"), F.concat(F.lit("w"), "wide"), given_name))
    edges = found.select("kind", "key", "pii_text", F.explode(contexts).alias("context"))
    edges = settled(edges.distinct().groupBy("kind", "key", "context").agg(F.count(F.lit(1)).alias("n")), "edges")
    known, patterns, state = seeds, None, None
    for r in range(rounds):
        at = edges.join(known, ["kind", "key"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        shares = at.groupBy("kind", "context").agg(F.sum("n").alias("keys"), F.sum(F.col("score") * F.col("n")).alias("s")).filter(F.col("s") >= support - 0.5).withColumn("p", F.col("s") / F.col("keys"))
        if r == 0:
            shares = settled(shares, "shares")
            step = shares.groupBy("kind", F.floor(F.col("p") * 100).alias("percent")).agg(F.sum("s").alias("s"))  # at most 101 rows a kind
            upto = F.sum("s").over(Window.partitionBy("kind").orderBy("percent")) / F.sum("s").over(Window.partitionBy("kind"))
            usual = step.withColumn("_upto", upto).filter("_upto >= 0.5").groupBy("kind").agg((F.min("percent") / 100).alias("usual"))
            patterns = shares.join(F.broadcast(usual), "kind").filter(F.col("p") >= F.least(F.lit(0.2), F.col("usual") / 2))  # a row a kind
        else:
            patterns = shares.filter("p >= 0.5")
        patterns = settled(patterns.select("kind", "context", "p"), "patterns")
        # A key is known by the share of its occurrences that stand in patterns; each occurrence has two contexts beside the given name, which counts half.
        named = F.col("context").startswith("g")
        weight = F.when(F.col("p").isNull(), 0.0).when(named, F.col("n") / 2).otherwise(F.col("n").cast("double"))
        own = edges.join(patterns, ["kind", "context"], "left").groupBy("kind", "key").agg((2 * F.sum(weight) / F.sum(F.when(named, 0).otherwise(F.col("n")))).alias("share"))
        known = settled(own.select("kind", "key", F.least(F.lit(1.0), "share").alias("score")).filter("score >= 0.5"), "known")
        now = (patterns.count(), *known.agg(F.count(F.lit(1)), F.round(F.sum("score"), 6)).first())
        if now == state:
            break
        state = now
    p = patterns.select("kind", "context", "p")
    best = found.join(p.filter("context LIKE 'n%'").select("kind", F.expr("substring(context, 2)").alias("near"), F.col("p").alias("pn")), ["kind", "near"], "left")
    best = best.join(p.filter("context LIKE 'w%'").select("kind", F.expr("substring(context, 2)").alias("wide"), F.col("p").alias("pw")), ["kind", "wide"], "left")
    best = best.join(known, ["kind", "key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pattern = F.greatest(zero("pn"), zero("pw"))
    best = best.withColumn("pattern", pattern).withColumn("known", zero("score"))
    # Numbers of different kinds share forms: an identity number needs its context, unless its form has letters.
    sure = F.when(F.col("kind") == "id_number", (F.col("pattern") >= 0.5) | (F.col("known") >= 0.9) & F.col("key").contains("A")).otherwise(F.col("known") >= 0.5)
    best = best.filter(sure).select("doc_id", "kind", "pii_text", "begin_at", (F.col("begin_at") + F.length("pii_text")).cast("int").alias("end_at"))
    # A given name with two family names, all three known.
    name = known.filter("kind = 'person'").select("key")
    first = given.select(F.col("part").alias("hint")).unionByName(p.filter("kind = 'person' AND context LIKE 'g%'").select(F.expr("substring(context, 2)").alias("hint"))).distinct()
    double = double.withColumns({f"_w{j}": F.split("key", " ")[j] for j in (0, 1)}).join(first, "hint", "left_semi")
    for w in ("_w0", "_w1"):
        double = double.join(name.withColumnRenamed("key", w), w, "left_semi")
    best = best.unionByName(double.select("doc_id", F.lit("person").alias("kind"), "pii_text", "begin_at", (F.col("begin_at") + F.length("pii_text")).cast("int").alias("end_at")))
    # A part of a longer entity of the same kind is none.
    along = Window.partitionBy("doc_id", "kind").orderBy("begin_at", F.desc("end_at"))
    reach = F.max("end_at").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("_reach", reach).filter("_reach IS NULL OR _reach < end_at").drop("_reach")


def redact(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """(doc_id, text): the texts with [KIND] in the place of each entity, all other characters as they were.

    Of entities that overlap the one that begins first goes, of two at one place the longer. Texts without an entity, empty
    and null texts stay as they are. doc_id must tell the rows apart; texts without one can't be searched and come out null.
    name: the column given out as doc_id, where it is another one.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("begin_at", "end_at", "kind")).alias("spans"))
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(name or doc_id).cast("bigint").alias("name")).join(spans, "doc_id", "left")
    docs = docs.select("name", F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"), "spans")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if marks:
                    at, parts = 0, []
                    for m in sorted(marks, key=lambda m: (m["begin_at"], -m["end_at"], m["kind"])):
                        if m["begin_at"] >= at:
                            parts += [t[at : m["begin_at"]], f"[{m['kind'].upper()}]"]
                            at = m["end_at"]
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    with few_rows_a_batch(documents.sparkSession):
        return settled(docs.mapInArrow(fill, "doc_id bigint, text string"), "redacted")
