"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from partmill.llm.chat import OP12_SQL, op12_chat
from partmill.llm.decontaminate import op1_decontaminate
from partmill.llm.divergence import OP13_SQL, op13_divergence
from partmill.llm.factorisation import op7_factorisation
from partmill.llm.fertility import op2_fertility
from partmill.llm.licenses import op4_licenses
from partmill.llm.mixing import OP10_SQL, op10_mixing
from partmill.llm.packing import op6_packing
from partmill.llm.private import op9_private
from partmill.llm.repair import op11_repair
from partmill.llm.simhash import op5_simhash
from partmill.llm.templates import op3_templates
from partmill.llm.token_counts import op8_token_counts


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_fertility": op2_fertility,
    "op3_templates": op3_templates,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_factorisation": op7_factorisation,
    "op8_token_counts": op8_token_counts,
    "op9_private": op9_private,
    "op10_mixing": op10_mixing,
    "op11_repair": op11_repair,
    "op12_chat": op12_chat,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

ORACLE_SQL = {"op10_mixing": OP10_SQL, "op12_chat": OP12_SQL, "op13_divergence": OP13_SQL}
