"""Recurring named characters of texts: candidates, review, references."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Word lists and patterns of the review rules.
PHRASE = rf"{T.B0}[A-Z][a-z]{{2,}}(?:\s+(?:of\s+|the\s+)?[A-Z][a-z]{{2,}}){{1,2}}{T.B1}"
NAME = rf"{T.B0}[A-Z][a-z]{{2,}}{T.B1}"
PHRASE_STOP = ("Project Gutenberg", "Alice Adventures", "Lewis Carroll", "Millennium Fulcrum", "How To Win", "Win Friends", "New York")
WORD_STOP = (
    "The And But Chapter Then When This That Once Her His She He They You Your What Why How Who Where Which There Here Nothing Anything Everything Well Yes No Oh One Come Look Dear Poor Please Mine Off "
    "Window Rain Lantern Bridge Home Moonrise Project Gutenberg Alice’s Adventures Wonderland Lewis Carroll Mock Turtle Rabbit Hare Cat Hatter Hearts"
).split()
NOT_NAMES = (
    "about after again all also another before business chapter contents culture every first for friend friends from good great happy into just lesson let music never new next now page part people "
    "principle second some story than their these thing things think time when with work world york baa baby fire"
).split() + ["white house"]
PLACES = ("york", "london", "paris", "america", "england", "china", "japan", "white house")
PLACE_PHRASES = "New York|United States|United Kingdom|Los Angeles|San Francisco"
ACTIONS = "said|asked|answered|replied|called|shouted|whispered|laughed|smiled|cried|followed|met|watched|walked|ran|looked|promised|wondered|thought|explained|saluted"
HONORIFICS = "mr|mrs|miss|dr|professor|queen|king|grandpa|grandma"
#: A known cast: name, aliases, priority. Used where a text has at least three of the signals, or its title says so.
CAST = (
    ("Alice", ("Alice",), 100), ("White Rabbit", ("White Rabbit", "Rabbit"), 65), ("Cheshire Cat", ("Cheshire Cat", "Cheshire Puss"), 80), ("Hatter", ("Hatter", "Mad Hatter"), 50), ("March Hare", ("March Hare",), 45),
    ("Mock Turtle", ("Mock Turtle",), 40), ("Queen", ("Queen", "Queen of Hearts"), 45), ("King", ("King", "King of Hearts"), 20), ("Caterpillar", ("Caterpillar",), 45), ("Gryphon", ("Gryphon",), 20), ("Duchess", ("Duchess",), 20),
    ("Dormouse", ("Dormouse",), 20), ("Dinah", ("Dinah",), 5),
)
GENERIC_ANCHORS = ("stable outfit", "warm expression", "simple silhouette")
CAST_SIGNALS = ("Alice", "White Rabbit", "Cheshire Cat", "Hatter", "March Hare", "Queen of Hearts", "Caterpillar")
CAST_TITLE = rf"{T.B0}alice{T.B1}|wonderland"
EPISODIC_TITLE = rf"{T.B0}(how to|win friends|influence people|effective speaking|self[-\s]?help|principles?){T.B1}"
EPISODIC_SIGNALS = (r"principle\s+[0-9]+", "summary", "how to", "people", "business", "course", "success", "chapter")


def exact_name(names: tuple[str, ...] | list[str]) -> str:
    """A pattern for any of the names as whole words, longest first, in any case."""
    ordered = sorted(dict.fromkeys(n for n in names if n), key=len, reverse=True)
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(regex.escape(n, special_only=True) for n in ordered) + r")(?![\p{L}\p{N}])"


def _folded(text: str) -> str:
    """Letters that differ by case only are the same, each in one place as before."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Cast:
    """An automaton of the names of several people: all of them are found in one pass over a text."""

    def __init__(self, people: list[list[str]]) -> None:
        """people: the names of each."""
        self.n, self.automaton, having = len(people), ahocorasick.Automaton(), {}
        for i, names in enumerate(people):
            for name in {_folded(n) for n in names if n}:
                having.setdefault(name, []).append(i)
        for name, who in having.items():
            self.automaton.add_word(name, (len(name), who))
        self.empty = not having
        if having:
            self.automaton.make_automaton()

    def places(self, text: str) -> list[list[tuple[int, int]]]:
        """For each person where a name of theirs stands as a whole word: (start, end), overlapping ones too."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        if self.empty:
            return out
        low = _folded(text)
        for last, (size, who) in self.automaton.iter(low):
            start, end = last + 1 - size, last + 1
            if (start and low[start - 1].isalnum()) or (end < len(low) and low[end].isalnum()):
                continue
            for i in who:
                out[i].append((start, end))
        return out

    def counts(self, text: str) -> list[int]:
        """How often each person is named. Of places that overlap the longest counts, then the first; each name is looked for after itself only."""
        return [count_ranges(found) for found in self.places(text)]

    def named(self, text: str) -> list[bool]:
        return [bool(found) for found in self.places(text)]


def count_ranges(places: list[tuple[int, int]]) -> int:
    """The number of places that are kept: longest first, then by start, those that overlap none that is kept."""
    kept: list[tuple[int, int]] = []
    for start, end in sorted(set(places), key=lambda p: (p[0] - p[1], p[0])):
        at = bisect_left(kept, (start, end))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            kept.insert(at, (start, end))
    return len(kept)


_NAMED: dict[tuple, Cast] = {}


def _cast(people: tuple[tuple[str, ...], ...]) -> Cast:
    """The automaton of a cast, kept while texts of the same document follow one another."""
    if people not in _NAMED:
        if len(_NAMED) >= 64:
            _NAMED.clear()
        _NAMED[people] = Cast([list(p) for p in people])
    return _NAMED[people]


def name_counts(docs: DataFrame, people: list[tuple[str, ...]]) -> DataFrame:
    """``docs`` (doc_id, text) with counts: how often each of ``people``, by any of their names, is named in the text. One pass for all of them."""
    known = tuple(tuple(p) for p in people)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_cast(known).counts(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "counts"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, counts array<bigint>")


def count_names(text: Column, names: tuple[str, ...]) -> Column:
    return F.regexp_count(text, F.lit(exact_name(names))).cast("long")


def uses_cast(title: Column, text: Column) -> Column:
    hits = sum((F.when(text.rlike(exact_name((s,))), 1).otherwise(0) for s in CAST_SIGNALS), F.lit(0))
    # a plain search comes first, and few texts get as far as the patterns
    named = F.when(F.contains(text, F.lit("Alice")), text.rlike(rf"(?<![\p{{L}}\p{{N}}_])Alice(?![\p{{L}}\p{{N}}_])") & (hits >= 3)).otherwise(False)
    return F.lower(T.text(title)).rlike(CAST_TITLE) | named


def is_episodic(title: Column, text: Column) -> Column:
    """Whether pages show changing people rather than a cast: by title, or by the signals of a long guide."""
    low = F.lower(T.text(text))
    score = sum((F.least(F.lit(4), F.regexp_count(low, F.lit(f"{T.B0}{s}{T.B1}"))) for s in EPISODIC_SIGNALS), F.lit(0))
    return F.lower(T.text(title)).rlike(EPISODIC_TITLE) | ((F.length(low) >= 50000) & (score >= 12) & low.rlike(f"{T.B0}principle{T.B1}"))


def title_phrases(title: Column) -> Column:
    """Neighbouring pairs and triples of a title's capitalised words."""
    words = F.regexp_extract_all(T.text(title), F.lit(rf"{T.B0}[A-Z][A-Za-z]{{2,}}{T.B1}"), F.lit(0))
    run = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(run(2), run(3))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, name, count of capitalised words."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(T.text(F.col("text")), F.lit(NAME), F.lit(0))).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("count"))


def phrase_counts(docs: DataFrame) -> DataFrame:
    """doc_id, name, count of capitalised phrases that no list and no title rules out. docs: doc_id, title, text."""
    found = docs.select("doc_id", title_phrases(F.col("title")).alias("own"), F.explode(F.regexp_extract_all(T.text(F.col("text")), F.lit(PHRASE), F.lit(0))).alias("name"))
    kept = found.where(~F.col("name").isin(*PHRASE_STOP) & ~F.array_contains("own", F.col("name")) & ~F.col("name").rlike(f"{T.B0}(Chapter|Illustration|Contents){T.B1}"))
    return kept.groupBy("doc_id", "name").agg(F.count("*").alias("count"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, name, aliases, count, score, source for docs (doc_id, title, text)."""
    text = T.text(F.col("text"))
    with_cast = docs.where(uses_cast(F.col("title"), text))
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, a)).alias("aliases"), F.lit(p).alias("priority")) for n, a, p in CAST])
    counted = name_counts(with_cast.select("doc_id", text.alias("text")), [(n, *a) for n, a, _ in CAST])
    cast = counted.select("doc_id", F.explode(F.arrays_zip(known.alias("known"), "counts")).alias("c")).select("doc_id", "c.known.*", F.col("c.counts").alias("count")).where("count > 0")
    cast = cast.select("doc_id", "name", "aliases", "count", (F.col("count") + F.col("priority")).alias("score"), F.lit("canonical").alias("source"))
    phrases = phrase_counts(docs).join(cast.select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    phrases = phrases.select("doc_id", "name", F.array("name").alias("aliases"), "count", F.col("count").alias("score"), F.lit("title-phrase").alias("source"))
    strong = cast.unionByName(phrases).where("count >= 2")
    guarded = strong.select("doc_id", F.explode(F.flatten(F.transform(F.array_append("aliases", F.col("name")), lambda a: F.split(a, r"\s+")))).alias("name")).where(~F.lower("name").isin("of", "the")).distinct()
    words = word_counts(docs).where(~F.col("name").isin(*WORD_STOP)).join(guarded, ["doc_id", "name"], "left_anti")
    words = words.select("doc_id", "name", F.array("name").alias("aliases"), "count", F.col("count").alias("score"), F.lit("capitalized-word").alias("source"))
    return strong.unionByName(words)


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for text, names in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            low = text.lower()
            cues = [m.start() for m in _CUE.finditer(low)]
            places = word_places(low) if cues else {}
            scores.append([{"name": n, "context": _score(n.lower(), low, places, cues)} for n in names])
        kind = pa.list_(pa.struct([("name", pa.string()), ("context", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, kind)], names=["doc_id", "scores"])


_ACTS_AFTER = regex.compile(rf"\s+(?:{ACTIONS})(?![a-z0-9_])")
_ACTS_BEFORE = regex.compile(rf"(?<![a-z0-9_])(?:{ACTIONS})\s+(?:to\s+|at\s+|with\s+|the\s+)?$")
_HONOURED = regex.compile(rf"(?<![a-z0-9_])(?:{HONORIFICS})\.?\s+$")


#: What a text must have for any name in it to get points, in lower case: an action word or an honorific. Where the letters around a name are cut off,
#: the end of a longer word counts for a cue before a name, and the start of one for a cue behind it.
_CUES = rf"(?:{ACTIONS}|{HONORIFICS})(?![a-z0-9_])|(?<![a-z0-9_])(?:{ACTIONS})"
_CUE = regex.compile(_CUES)
_LETTERS = regex.compile(r"[^\W_]+")


def word_places(low: str) -> dict[str, list[int]]:
    """Where each word (a run of letters and digits) of a lower-case text starts."""
    places: dict[str, list[int]] = {}
    for m in _LETTERS.finditer(low):
        places.setdefault(m.group(), []).append(m.start())
    return places


def _whole_words(word: str, low: str, places: dict[str, list[int]] | None = None) -> Iterator[int]:
    """Places of a lower-case name, of one or more words, that no letter or digit touches."""
    places = word_places(low) if places is None else places
    first = _LETTERS.search(word)
    for at in places.get(first.group(), ()) if first else ():
        end = at + len(word)
        if low.startswith(word, at) and not (end < len(low) and low[end].isalnum()):
            yield at


def _score(word: str, low: str, places: dict[str, list[int]], cues: list[int]) -> int:
    """cues: where those of the text start, in order. Of some that overlap one is enough: the 48 letters are taken for 64."""
    points = 0
    for at in _whole_words(word, low, places):
        first = bisect_left(cues, at - 64)
        if first == len(cues) or cues[first] > at + len(word) + 64:
            continue
        near = low[max(0, at - 48) : at + len(word) + 48]
        spots = list(_whole_words(word, near))
        acts = any(_ACTS_AFTER.match(near, i + len(word)) or _ACTS_BEFORE.search(near[:i]) for i in spots)
        points += 2 * acts + any(_HONOURED.search(near[:i]) is not None for i in spots)
        if points >= 6:
            break
    return points


def context_score(name: str, text: str) -> int:
    """Points for actions next to a name and for honorifics before it, within 48 letters; counting ends at 6 or more.

    A name starts with a letter or digit. A text's words are looked up once for all its names, see ``word_places``.
    """
    low = text.lower()
    return _score(name.lower(), low, word_places(low), [m.start() for m in _CUE.finditer(low)])


def review(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Candidates with context, review_score, status (approved, review or rejected) and reason; the first rule that holds decides."""
    found = candidates(docs) if found is None else found
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = T.text(F.col("text"))
    facts = docs.select("doc_id", text.rlike(rf"{T.B0}New\s+York{T.B1}").alias("has_new_york"))
    # points need an action word or an honorific next to a name: texts without any have none, and go nowhere
    cued = docs.where(F.lower(text).rlike(_CUES)).select("doc_id", text.alias("text"))
    names = found.join(cued.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("name").alias("names"))
    scored = cued.join(names, "doc_id").select("doc_id", "text", "names").mapInArrow(_context, f"doc_id {kind}, scores array<struct<name:string,context:bigint>>")
    rows = found.join(scored.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.*"), ["doc_id", "name"], "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit(0).cast("long"))).join(facts, "doc_id")
    plain = F.lower(T.trim(F.regexp_replace("name", "[’‘]", "'")))
    several = F.col("name").rlike(r"\s")
    place = plain.isin(*PLACES) | ((plain == "new") & F.col("has_new_york")) | F.col("name").rlike(f"{T.B0}(?:{PLACE_PHRASES}){T.B1}")
    rules = [
        (plain.isin(*NOT_NAMES), "rejected", "common word or title fragment, not a stable character"),
        (place, "rejected", "place or location phrase"),
        (F.col("source") == "canonical", "approved", "known recurring story character"),
        (F.col("count") < 2, "rejected", "only mentioned once"),
        (~several & (F.col("count") < 3) & (F.col("context") == 0), "rejected", "weak single-word signal without character action context"),
        (~several & (F.col("context") == 0), "review", "recurring proper-name candidate needs story/action context review"),
        (F.col("context") > 0, "approved", "recurring named entity with story/action context"),
    ]
    status, reason = F.lit("approved"), F.lit("recurring proper-name candidate")
    for test, s, r in reversed(rules):
        status, reason = F.when(test, s).otherwise(status), F.when(test, r).otherwise(reason)
    score = F.col("score") + F.col("context") + F.when(several, 2).otherwise(0)
    return rows.select("doc_id", "name", "aliases", "count", "score", "context", score.alias("review_score"), status.alias("status"), reason.alias("reason"), "source")


def characters(docs: DataFrame, reviewed: DataFrame, most: int = 10) -> DataFrame:
    """The best approved candidates by document, with what they look like; a generic protagonist where there are none."""
    order = [F.desc("review_score"), F.desc("score"), F.desc("count"), F.expr("name COLLATE UNICODE")]
    ranked = reviewed.where("status = 'approved'").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("rank") <= most)
    rows = docs.select("doc_id").distinct().join(ranked.select("doc_id", "rank", "name", "aliases", "count"), "doc_id", "left")
    own = lambda found, other: F.when(F.col("name").isNotNull(), found).otherwise(other)
    return rows.select(
        "doc_id", F.coalesce("rank", F.lit(1)).cast("int").alias("rank"), own(T.slug(F.col("name"), F.concat(F.lit("character-"), F.col("rank").cast("string"))), F.lit("protagonist")).alias("id"), F.coalesce("name", F.lit("Protagonist")).alias("name"),
        F.coalesce("aliases", F.array(F.lit("Protagonist"))).alias("aliases"), F.coalesce("count", F.lit(0).cast("long")).alias("source_mentions"),
        own(T.description(F.col("name"), F.col("rank") - 1), F.lit("A gentle recurring protagonist designed with a stable outfit and warm expression.")).alias("description"),
        F.lit("needs_generation").alias("reference_status"), own(T.visual_anchors(F.col("name"), F.col("rank") - 1), F.array(*map(F.lit, GENERIC_ANCHORS))).alias("visual_anchors"),
    )


def review_summary(docs: DataFrame, reviewed: DataFrame, most: int = 10, disabled: Column | None = None) -> DataFrame:
    """Counts of decisions by document, and ready, review or fallback. Where ``disabled``, approved names are folded into the rejected."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = reviewed.groupBy("doc_id").agg(F.least(n("approved"), F.lit(most)).alias("approved"), n("rejected").alias("rejected"), n("review").alias("pending"))
    rows = docs.select("doc_id").distinct().join(counts, "doc_id", "left").fillna(0, ["approved", "rejected", "pending"])
    status = F.when(F.col("approved") == 0, "fallback").when(F.col("pending") > 0, "review").otherwise("ready")
    rows = rows.select("doc_id", status.alias("status"), F.when(F.col("approved") == 0, 1).otherwise(F.col("approved")).cast("long").alias("approved_count"), F.col("rejected").alias("rejected_count"), F.col("pending").alias("review_count"))
    if disabled is None:
        return rows
    off = docs.select("doc_id", disabled.alias("off"))
    rows = rows.join(off, "doc_id")
    return rows.select("doc_id", F.when(F.col("off"), "not_used").otherwise(F.col("status")).alias("status"), F.when(F.col("off"), 0).otherwise(F.col("approved_count")).alias("approved_count"), F.when(F.col("off"), F.col("rejected_count") + F.col("approved_count") + F.col("review_count")).otherwise(F.col("rejected_count")).alias("rejected_count"), F.when(F.col("off"), 0).otherwise(F.col("review_count")).alias("review_count"))


def _refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        refs = []
        for text, cast in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            people = sorted(cast or [], key=lambda p: (p["rank"], p["id"]))
            seen = _cast(tuple(tuple(p["names"]) for p in people)).named(text)
            refs.append([p["id"] for p, here in zip(people, seen, strict=True) if here])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(refs, pa.list_(pa.string()))], names=["doc_id", "spread_id", "character_refs"])


def references(pages: DataFrame, people: DataFrame, text: str = "source_passage") -> DataFrame:
    """doc_id, spread_id and the ids of the document's characters that the page names, by rank.

    A document's characters, a short list, are joined to its pages in one equi-join. An automaton of all their names is made once for each cast and
    passes once over each page's text.
    """
    cast = people.groupBy("doc_id").agg(F.collect_list(F.struct("rank", "id", F.filter(F.array_sort(F.array_distinct(F.array_append("aliases", F.col("name")))), lambda n: n != "").alias("names"))).alias("cast"))
    rows = pages.select("doc_id", "spread_id", T.text(F.col(text)).alias("t")).join(cast, "doc_id", "left")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("doc_id", "spread_id")}
    return rows.select("doc_id", "spread_id", "t", "cast").mapInArrow(_refer, f"doc_id {kinds['doc_id']}, spread_id {kinds['spread_id']}, character_refs array<string>")
