"""Drafts of a translation as a graph of stages that read what earlier ones stored, and new drafts after a term's translation was chosen.

Chunks are rows (doc, position, chunk, content); a chunk's surroundings are those of its document at most AROUND positions away. Neighbours
meet by an equal join on document and position, so a document of any size is spread over all tasks. Passages that are like a chunk come
as a table (chunk, other, rank), such as the vector index gives; those in the surroundings are passed over and the first SIMILAR of the
rest count, with their latest drafts, as far as they have one. What a model is asked is a text of titled sections, empty ones left out.

Null contents count as empty. A model that gives nothing or white space for a chunk makes no draft of it, and stages that would have read it leave the
section out. Repeated chunks must not be given: (doc, position) and chunk name a row. Empty tables give empty drafts.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .context import latest_draft
from .graph import scratch
from .providers import Translator, prompt

AROUND, SIMILAR = 2, 3


class Model(Protocol):
    name: str

    def answer(self, requests: DataFrame) -> DataFrame:
        """chunk, content out of chunk, content, prompt."""


class Fingerprint:
    """Answers with the digest of what it was asked; a stand-in for a model that shows whether a request was the right one."""

    name = "ai:fingerprint"

    def answer(self, requests: DataFrame) -> DataFrame:
        return requests.select("chunk", F.sha2("prompt", 256).alias("content"))


@dataclass(frozen=True)
class Stage:
    """A draft's number, the draft that it must see (none: the latest, if `revises`), and whether it reads drafts of the surroundings."""

    number: int
    sees: int | None = None
    revises: bool = False


#: With the machine's translation as a hint, without it, and revised by what stands around.
STAGES = (Stage(0, sees=-1), Stage(1), Stage(2, revises=True))


def around(chunks: DataFrame, value: str, before: str, after: str, of: DataFrame | None = None) -> DataFrame:
    """chunk, and the values of at most AROUND chunks before and after it, by position, joined by new lines; no row if there are none.

    of: the chunks to be told about, if not all."""
    steps = [k for k in range(-AROUND, AROUND + 1) if k]
    given = chunks.where(F.coalesce(F.col(value), F.lit("")) != "").select("doc", F.col("position").alias("at"), F.col(value).alias("v"))
    given = given.select("doc", "at", "v", F.explode(F.array(*(F.lit(k) for k in steps))).alias("k")).withColumn("position", F.col("at") - F.col("k"))
    met = (chunks if of is None else of).select("doc", "position", "chunk").join(given, ["doc", "position"])
    text = lambda sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") * sign > 0, F.struct("k", "v")))), lambda x: x["v"]), "\n")
    return met.groupBy("chunk").agg(text(-1).alias(before), text(1).alias(after))


def alike(chunks: DataFrame, similar: DataFrame) -> DataFrame:
    """chunk, other, rank: the first SIMILAR passages for each chunk that are not the chunk itself and not in its surroundings; ties go to the smaller id."""
    place = chunks.select("doc", "position", "chunk")
    other = place.select(F.col("doc").alias("other_doc"), F.col("position").alias("other_position"), F.col("chunk").alias("other"))
    near = (F.col("doc") == F.col("other_doc")) & (F.abs(F.col("position") - F.col("other_position")) <= AROUND)
    far = similar.select("chunk", "other", "rank").distinct().join(place, "chunk").join(other, "other").where(~F.coalesce(near, F.lit(False)) & (F.col("chunk") != F.col("other")))
    # a limit by rank is taken before the shuffle too, so however many passages a chunk is given, few of them travel
    nth = F.row_number().over(Window.partitionBy("chunk").orderBy("rank", "other"))
    return far.withColumn("n", nth).where(F.col("n") <= SIMILAR).select("chunk", "other", "rank")


def _examples(chunks: DataFrame, close: DataFrame, last: DataFrame) -> DataFrame:
    """chunk, examples: passages like a chunk with their latest drafts, a line each."""
    shown = chunks.select(F.col("chunk").alias("other"), F.coalesce("content", F.lit("")).alias("source")).join(last.select(F.col("chunk").alias("other"), F.col("content").alias("draft")), "other")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", F.concat("source", F.lit(" → "), "draft").alias("line")))), lambda x: x["line"])
    return close.join(shown, "other").groupBy("chunk").agg(F.array_join(lines, "\n").alias("examples"))


_FIRST = (("Before", "before"), ("Text", "content"), ("After", "after"), ("Similar passages", "examples"))


def _asked(chunks: DataFrame, given: list[DataFrame], *sections: tuple[str, str]) -> DataFrame:
    """chunk, content, prompt: chunks with tables of one row a chunk, as a request."""
    for df in given:
        chunks = chunks.join(df, "chunk", "left")
    return chunks.select("chunk", F.coalesce("content", F.lit("")).alias("content"), prompt(*_FIRST, *sections).alias("prompt"))


def _kept(answers: DataFrame, number: object, name: str) -> DataFrame:
    clean = answers.withColumn("content", F.regexp_replace("content", r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")).where("content <> ''")
    return clean.select("chunk", F.lit(number).cast("int").alias("draft_number"), F.lit(name).alias("translator"), "content")


def draft_all(chunks: DataFrame, similar: DataFrame, machine: Translator, model: Model, stages: tuple[Stage, ...] = STAGES) -> DataFrame:
    """chunk, draft_number, translator, content: the machine's draft (-1), then one of each stage, written before the next one reads it.

    A stage sees every draft of the stages before it, of all chunks."""
    spark, path = chunks.sparkSession, scratch(chunks.sparkSession)
    write = lambda df, name: df.write.parquet(f"{path}/{name}")
    read = lambda *names: spark.read.parquet(*(f"{path}/{n}" for n in names))
    write(around(chunks, "content", "before", "after"), "around")
    write(alike(chunks, similar), "alike")
    write(_kept(machine.translate(chunks), -1, machine.name), "draft-0")
    done = ["draft-0"]
    for stage in stages:
        drafts = read(*done)
        last = latest_draft(drafts)
        given, sections = [read("around"), _examples(chunks, read("alike"), last)], []
        if stage.sees is not None:
            given.append(drafts.where(F.col("draft_number") == stage.sees).select("chunk", F.col("content").alias("hint")))
            sections.append(("Machine translation", "hint"))
        if stage.revises:
            own = last.select("chunk", F.col("content").alias("draft"))
            given += [around(chunks.join(own, "chunk", "left"), "draft", "drafts_before", "drafts_after"), own]
            sections += [("Drafts before", "drafts_before"), ("Drafts after", "drafts_after"), ("Draft", "draft")]
        name = f"draft-{len(done)}"
        write(_kept(model.answer(_asked(chunks, given, *sections)), stage.number, model.name), name)
        done.append(name)
    return read(*done)


def retranslate(chunks: DataFrame, drafts: DataFrame, similar: DataFrame, terms: DataFrame, model: Model) -> DataFrame:
    """chunk, draft_number, translator, content: a new draft of each chunk that terms (chunk, text, translation) names.

    Its number follows the chunk's largest (0 at least). The model sees the latest draft and all of the chunk's terms, by text and
    translation; repeated ones count once, blank ones and chunks that are not there not at all."""
    lines = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("「"), "text", F.lit("」 → \""), "translation", F.lit('"')))), "\n")
    wanted = terms.where("trim(text) <> '' AND trim(translation) <> ''").groupBy("chunk").agg(lines.alias("terms"))
    some = chunks.join(wanted.select("chunk"), "chunk", "left_semi")
    near = around(chunks, "content", "before", "after", some)
    last = latest_draft(drafts)
    close = alike(chunks, similar.join(some.select("chunk"), "chunk", "left_semi"))
    own = last.select("chunk", F.col("content").alias("draft"), "draft_number")
    asked = _asked(some, [near, _examples(chunks, close, last), own.drop("draft_number"), wanted], ("Draft", "draft"), ("Chosen translations", "terms"))
    made = _kept(model.answer(asked), 0, model.name).drop("draft_number").join(own.select("chunk", "draft_number"), "chunk", "left")
    return made.select("chunk", (F.greatest(F.coalesce("draft_number", F.lit(0)), F.lit(0)) + 1).cast("int").alias("draft_number"), "translator", "content")
