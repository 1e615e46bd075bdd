"""Prompt columns. The domain and the place to ask are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = (
    "You answer questions about {domain}.\n\nUse only the context below. If it is not enough, say: \"I'm not sure based on what I've indexed; "
    "please check {authority}.\" Add no facts of your own. Decline questions about anything else.\nBe concise.\n\nContext:\n"
)
REWRITE = "Rewrite the last question so that it can be understood without the conversation. Return it unchanged if it already can. Give the question only."
FAITHFUL = "Is every claim of the answer supported by the context? Reply YES or NO."
RELEVANT = "Does the answer address the question? Reply YES or NO."
VARIANTS = "Give exactly {n} other search queries for the question, one a line and nothing else: first close to its wording, then in the terms of {domain}, then in plain words.\n\nQuestion: "
RERANK = "Sort all documents by how directly they answer the query. Reply with their ids, best first.\n\n"


def _talk(history: Column) -> Column:
    return F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def answer(context: Column, history: Column, question: Column, domain: str = "the indexed documents", authority: str = "the source itself") -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit(ANSWER.format(domain=domain, authority=authority)), context), _talk(history), F.concat(F.lit("user: "), question))


def rewrite(history: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(REWRITE), _talk(history), F.concat(F.lit("user: "), question))


def variants(question: Column, n: int, domain: str = "the indexed documents") -> Column:
    return F.concat(F.lit(VARIANTS.format(n=n, domain=domain)), question)


def rerank(blocks: Column, query: Column) -> Column:
    return F.concat(F.lit(RERANK), blocks, F.lit("\n\nQuery: "), query)


def faithful(context: Column, answer: Column) -> Column:
    return F.concat(F.lit(FAITHFUL + "\n\nContext:\n"), context, F.lit("\n\nAnswer:\n"), answer)


def relevant(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(RELEVANT + "\n\nQuestion:\n"), question, F.lit("\n\nAnswer:\n"), answer)
