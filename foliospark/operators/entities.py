"""Entities from chunks: sampling, batches, a rule extractor or a model, attribution and first-wins storage."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id, entity_type, first_json_array, normal_name

#: Capitalised words of four letters or more.
RULE = "[A-Z][a-z]{3,}"
# Characters of a text that are shown to a model, and of a chunk that is worth it.
SHOWN, WORTH = 3000, 100
ANSWER = "struct<name:string,type:string,mention_text:string,context:string>"


def sample(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_index, content) of 100 characters or more that are among a document's first three or every fifth."""
    return chunks.where((F.length("content") >= WORTH) & ((F.col("chunk_index") < 3) | (F.col("chunk_index") % 5 == 0)))


def batched(chunks: DataFrame, size: int = 3) -> DataFrame:
    """chunks (doc_id, chunk_index) with a batch number within their document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    return chunks.withColumn("batch", F.floor(place / size).cast("int"))


def extract(chunks: DataFrame, keys: list[str], pattern: str = RULE) -> DataFrame:
    """keys, name, type, entity_id by rule: each match is a person's mention."""
    found = chunks.select(*keys, F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("name"))
    return found.select(*keys, "name", F.lit("PERSON").alias("type"), entity_id(F.lit("PERSON"), F.col("name")).alias("entity_id"))


#: What a model is asked, by language.
QUESTIONS = {
    "fr": "Relève les personnes, lieux, dates, organisations et événements du texte. Réponds par une liste JSON d'objets avec name, type (PERSON, LOCATION, DATE, ORGANIZATION, EVENT ou CONCEPT) et mention_text, rien d'autre.\n\nTexte :\n",
    "en": "Find the persons, places, dates, organisations and events of the text. Answer with a JSON list of objects with name, type (PERSON, LOCATION, DATE, ORGANIZATION, EVENT or CONCEPT) and mention_text, and nothing else.\n\nText:\n",
    "de": "Finde Personen, Orte, Daten, Organisationen und Ereignisse des Textes. Antworte mit einer JSON-Liste von Objekten mit name, type (PERSON, LOCATION, DATE, ORGANIZATION, EVENT oder CONCEPT) und mention_text, sonst nichts.\n\nText:\n",
}


def question(text: Column, language: str = "fr") -> Column:
    """What a model is asked about a text, of which it sees the first 3000 characters; unknown languages get French."""
    return F.concat(F.lit(QUESTIONS.get(language, QUESTIONS["fr"])), F.substring(text, 1, SHOWN))


def asking(ask: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column of answers from ask, a function from one text to its answer. What times out is asked once more;
    what fails has no answer, and the rest goes on."""

    def answer(text):
        for last in (False, True):
            try:
                return ask(text)
            except TimeoutError:
                if last:
                    return None
            except Exception:
                return None

    @F.pandas_udf("string")
    def answers(texts: pd.Series) -> pd.Series:
        return texts.map(answer, na_action="ignore")

    return answers


def process(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, model: Callable, language: str = "fr") -> tuple[DataFrame, DataFrame]:
    """entities (entity_id, name, type) and mentions (doc_id, chunk_index, entity_id, context) of documents (doc_id)
    that mentions (doc_id) lacks, by a model (see extract_with_model).

    Of chunks (doc_id, chunk_index, content) a sample goes to the model, three of a document at a time. A mention is
    its batch's first chunk's whose content holds its context, letter case aside, else the first chunk's. Of an
    entity's names the last in a batch counts, and of batches the first.
    """
    new = documents.select("doc_id").join(mentions.select("doc_id"), "doc_id", "left_anti")
    batch = batched(sample(chunks.join(new, "doc_id", "left_semi"))).select("doc_id", "batch", "chunk_index", "content")
    some = batch.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("some"))
    parts = F.transform("some", lambda x, i: F.concat(F.lit("[Section "), (i + 1).cast("string"), F.lit("]\n"), x["content"]))
    text = F.when(F.size("some") == 1, F.get("some", 0)["content"]).otherwise(F.array_join(parts, "\n\n"))
    answers = some.select("doc_id", "batch", "some", model(question(text, language)).alias("answer"))
    found = read_answers(answers.withColumn("answer", F.coalesce("answer", F.lit(""))), ["doc_id", "batch", "some"])
    there = F.filter("some", lambda x: F.contains(F.lower(x["content"]), F.lower(F.col("context"))))
    at = F.coalesce(F.get(there, 0)["chunk_index"], F.get("some", 0)["chunk_index"])
    found = found.select("doc_id", "batch", "place", "name", "type", "entity_id", "context", at.alias("chunk_index"))
    of_batch = found.groupBy("doc_id", "batch", "entity_id").agg(F.max_by(F.struct("name", "type"), "place").alias("e"))
    entities = of_batch.groupBy("entity_id").agg(F.min_by("e", F.struct("doc_id", "batch")).alias("e")).select("entity_id", "e.name", "e.type")
    return entities, found.select("doc_id", "chunk_index", "entity_id", "context")


def extract_with_model(chunks: DataFrame, keys: list[str], model: Callable) -> DataFrame:
    """As extract, by a model: a function from a column of texts to a column of its answers (a pandas UDF, say).

    Answers are JSON lists of {name, type, context}, with or without text around; what can't be read, has no
    name or is of no known type is left out.
    """
    return read_answers(chunks.select(*keys, model(F.substring("content", 1, SHOWN)).alias("answer")), keys).drop("place")


def read_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, name, type, context, entity_id of answers (keys, answer): place is an entity's in its answer."""
    each = answers.select(*keys, F.posexplode(first_json_array(F.col("answer"), ANSWER)).alias("place", "e"))
    named = each.select(*keys, "place", F.col("e.name").alias("name"), entity_type(F.col("e.type")).alias("type"), F.coalesce(F.nullif(F.col("e.mention_text"), F.lit("")), F.nullif(F.col("e.context"), F.lit("")), F.col("e.name")).alias("context"))
    return named.where("type is not null and name is not null").where(normal_name(F.col("name")) != "").withColumn("entity_id", entity_id(F.col("type"), F.col("name")))


def attribute(names: DataFrame, batch: DataFrame) -> DataFrame:
    """names (doc_id, batch, name) with the first chunk of their batch that contains the name, else its first."""
    both = names.join(batch.select("doc_id", "batch", "chunk_index", "content"), ["doc_id", "batch"])
    return both.groupBy("doc_id", "batch", "name").agg(F.coalesce(F.min(F.when(F.contains("content", F.col("name")), F.col("chunk_index"))), F.min("chunk_index")).alias("chunk_index"))


def first_wins(entities: DataFrame, order: str) -> DataFrame:
    """One row for each entity_id: the first in order."""
    return entities.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy(order))).where("_r = 1").drop("_r")
