"""Characters of titles: found from labels and speakers, corrected by users."""

from __future__ import annotations

from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import Fold, ordered_fold
from ..operators.intervals import as_of
from ..operators.settle import settle

C = F.col
#: A time before all others.
ALWAYS = -(1 << 62)


def ensure_characters(mentions: DataFrame) -> DataFrame:
    """title_id, key, character_id, name, first_ms, lines: one for each normalized name or speaker, numbered by first appearance.

    mentions: title_id, at_ms, seq, name, speaker.
    """
    key = F.coalesce(F.concat(F.lit("name:"), F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))), F.concat(F.lit("speaker:"), C("speaker")))
    m = mentions.withColumn("key", key).where("key is not null")
    one = m.groupBy("title_id", "key").agg(F.min(F.struct("at_ms", "seq")).alias("f"), F.min_by("name", F.struct("at_ms", "seq")).alias("name"), F.count("*").alias("lines"))
    number = F.row_number().over(Window.partitionBy("title_id").orderBy("f"))
    return one.select("title_id", "key", F.concat(F.lit("character-"), number.cast("string")).alias("character_id"), "name", C("f.at_ms").alias("first_ms"), "lines")


def cue_name(characters: DataFrame) -> DataFrame:
    """Adds cue: the name, else SPEAKER n by first appearance among the nameless, else UNKNOWN SPEAKER."""
    nameless = C("key").startswith("speaker:")
    n = F.sum(F.when(nameless, 1).otherwise(0)).over(Window.partitionBy("title_id").orderBy("first_ms", "key"))
    return characters.withColumn("cue", F.coalesce(F.upper("name"), F.when(nameless, F.concat(F.lit("SPEAKER "), n.cast("string"))), F.lit("UNKNOWN SPEAKER")))


class Resolve(Fold):
    """Reads a title's log from its end and tells what becomes of each character and of each line that was assigned by itself.

    What becomes of a character after an entry is known when the entry is read, so an entry only names what is there: ``merge``
    gives from_id the fate of to_id, ``forward`` parts it by time, ``split`` by speaker. The state is one node for each entry. A
    fate is (id,), or (is it a time, time or speaker, fate if at or after it or if spoken so, fate else). flush gives the fates as
    effective-dated rows: line_seq or character_id, since, what each speaker of a split gets from then on, what all others get.
    """

    def __init__(self) -> None:
        self.fates: dict[str, tuple] = {}
        self.lines: dict[Any, tuple] = {}

    def _fate(self, character: str | None) -> tuple:
        return self.fates.get(character, (character,)) if character is not None else (None,)

    def push(self, r):
        if r.op == "single":
            if r.line_seq is not None:
                self.lines.setdefault(r.line_seq, self._fate(r.to_id))
        elif r.from_id is None:
            pass
        elif r.op == "remove":
            self.fates[r.from_id] = (None,)
        elif r.op == "merge":
            self.fates[r.from_id] = self._fate(r.to_id)
        elif r.op == "forward" and r.since is not None:
            self.fates[r.from_id] = (True, r.since, self._fate(r.to_id), self._fate(r.from_id))
        elif r.op == "split" and r.speaker is not None:
            self.fates[r.from_id] = (False, r.speaker, self._fate(r.to_id), self._fate(r.from_id))
        return []

    @staticmethod
    def dated(fate: tuple) -> list[tuple]:
        """(since, {speaker: id}, id of all others) of a fate, in order of time."""
        edges, todo = [], [(fate, ALWAYS, None, None, frozenset())]
        while todo:
            node, low, high, who, others = todo.pop()
            if len(node) == 1:
                edges.append((low, True, who, node[0]))
                if high is not None:
                    edges.append((high, False, who, None))
                continue
            timed, at, yes, no = node
            if timed:
                if high is None or high > at:
                    todo.append((yes, max(low, at), high, who, others))
                if low < at:
                    todo.append((no, low, at if high is None else min(high, at), who, others))
            elif who is not None or at in others:
                todo.append((yes if who == at else no, low, high, who, others))
            else:
                todo += [(yes, low, high, at, others), (no, low, high, None, others | {at})]
        out, now = [], {}
        # at one time what ends goes before what begins
        for since, here in groupby(sorted(edges, key=lambda e: e[:2]), key=lambda e: e[0]):
            for _, begins, who, to in here:
                if begins:
                    now[who] = to
                else:
                    now.pop(who, None)
            said = {w: to for w, to in now.items() if w is not None}
            if not out or out[-1][1:] != (said, now.get(None)):
                out.append((since, said, now.get(None)))
        return out

    def flush(self):
        fates = [(None, c, f) for c, f in self.fates.items()] + [(line, None, f) for line, f in self.lines.items()]
        return [(line, c, since, list(said.items()), other) for line, c, f in fates for since, said, other in self.dated(f)]


def resolve_log(log: DataFrame) -> DataFrame:
    """title_id, line_seq, character_id, since, said (speaker to id), other: the log of each title as effective-dated rows.

    A row holds from ``since`` to the next of its line or character. A title's log, which its users wrote, is the state of one fold.
    """
    speaker = C("speaker_id") if "speaker_id" in log.columns else F.lit(None).cast("string")
    entries = log.where("op != 'rename' and title_id is not null").select("title_id", "log_seq", "op", "from_id", "to_id", "line_seq", C("at_ms").alias("since"), speaker.alias("speaker"))
    number = F.row_number().over(Window.partitionBy("title_id").orderBy("log_seq", "op", "from_id", "to_id", "line_seq", "since", "speaker"))
    kind = dict(log.dtypes)
    schema = f"title_id {kind['title_id']}, line_seq {kind['line_seq']}, character_id string, since long, said map<string, string>, other string"
    return ordered_fold(entries.withColumn("back", -number), ["title_id"], ["back"], Resolve, schema)


def apply_corrections(lines: DataFrame, log: DataFrame) -> DataFrame:
    """lines (title_id, seq, at_ms, character_id and perhaps speaker_id) with the corrections' last word as character_id.

    log: title_id, log_seq, op, from_id, to_id, line_seq, at_ms and perhaps speaker_id. ``single`` assigns one line; ``forward``
    gives all lines of from_id from at_ms on to to_id; ``merge`` gives it all of from_id's; ``split`` gives it those of from_id
    that speaker_id speaks; ``remove`` leaves from_id's lines without a character; ``rename`` moves none. An entry sees what
    those before it made of a line. Each title's log is resolved once; lines then meet it in one as-of join by their character,
    or by themselves where they were assigned singly. An entry without what it needs (from_id, at_ms, speaker_id, line_seq) does
    nothing; a line without a time is in no ``forward``.
    """
    resolved = settle(resolve_log(log), "corrections")
    own = resolved.select("title_id", C("line_seq").cast(dict(lines.dtypes)["seq"]).alias("seq")).where("seq is not null").distinct().withColumn("_alone", F.lit(True))
    key = lambda line, character: F.struct(C("title_id"), line.alias("line"), character.alias("character")).alias("_key")
    rules = resolved.select(key(C("line_seq").cast(dict(lines.dtypes)["seq"]), C("character_id")), C("since").alias("at_ms"), C("since").alias("seq"), "said", "other")
    spoken = C("speaker_id") if "speaker_id" in lines.columns else F.lit(None).cast("string")
    asked = lines.select("title_id", "seq", "at_ms", C("character_id").cast("string").alias("character_id"), spoken.cast("string").alias("_speaker")).join(own.hint("merge"), ["title_id", "seq"], "left")
    asked = asked.select(
        key(F.when(C("_alone"), C("seq")), F.when(C("_alone").isNull(), C("character_id"))), "title_id", "seq", C("at_ms").alias("_at"), "character_id", "_speaker", F.coalesce("at_ms", F.lit(ALWAYS)).alias("at_ms")
    )
    met = as_of(asked, rules, ["seq", "said", "other"], by="_key")
    named = C("_speaker").isNotNull() & F.coalesce(F.array_contains(F.map_keys("r_said"), C("_speaker")), F.lit(False))
    now = F.when(C("r_seq").isNull(), C("character_id")).when(named, F.try_element_at("r_said", C("_speaker"))).otherwise(C("r_other"))
    return met.select("title_id", "seq", C("_at").alias("at_ms"), now.alias("character_id"))


def corrected_characters(characters: DataFrame, log: DataFrame) -> DataFrame:
    """characters (title_id, character_id, name, first_ms, lines) after merges, removals and renames.

    A merge adds up lines, keeps the earliest appearance and the names as aliases; a rename gives the name (log column name)
    and keeps the former one as an alias; what users touched is of confidence high and source user.
    """
    ids = characters.select("title_id", C("character_id").alias("seq"), C("first_ms").alias("at_ms"), "character_id")
    moved = apply_corrections(ids, log.where("op in ('merge', 'remove')")).select("title_id", C("seq").alias("character_id"), C("character_id").alias("into"))
    renamed = log.where("op = 'rename'").groupBy("title_id", C("from_id").alias("into")).agg(F.max_by("name", "log_seq").alias("said"), F.array_sort(F.collect_list(F.struct("log_seq", "name"))).alias("names"))
    rows = characters.join(moved.hint("merge"), ["title_id", "character_id"]).where("into is not null")
    own = C("character_id") == C("into")
    one = rows.groupBy("title_id", "into").agg(
        F.max(F.when(own, C("name"))).alias("name"), F.min("first_ms").alias("first_ms"), F.sum("lines").alias("lines"), F.count("*").alias("_n"), F.array_sort(F.collect_set("name")).alias("_names")
    )
    out = one.join(renamed.hint("merge"), ["title_id", "into"], "left").withColumn("name", F.coalesce(F.upper("said"), "name"))
    former = F.transform(F.coalesce("names", F.array().cast(renamed.schema["names"].dataType)), lambda x: F.upper(x["name"]))
    alias = F.array_sort(F.array_distinct(F.filter(F.concat("_names", former), lambda x: ~x.eqNullSafe(C("name")))))
    touched = (C("_n") > 1) | C("said").isNotNull()
    return out.select("title_id", C("into").alias("character_id"), "name", alias.alias("aliases"), "first_ms", "lines", F.when(touched, "user").otherwise("evidence").alias("source"), F.when(touched, "high").otherwise("medium").alias("confidence"))
