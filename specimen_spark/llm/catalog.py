"""Registered queries of this folder and their check SQL."""

import corpus_pipeline
from specimen_spark.llm.alignment import op13_alignment
from specimen_spark.llm.ann import op6_ann
from specimen_spark.llm.chat import op8_chat
from specimen_spark.llm.decontaminate import OP1_SQL, op1_decontamination
from specimen_spark.llm.jaccard import OP9_SQL, op9_jaccard
from specimen_spark.llm.linededup import OP10_SQL, op10_linededup
from specimen_spark.llm.packing import op2_packing
from specimen_spark.llm.ppm import op11_ppm
from specimen_spark.llm.quality import op5_quality
from specimen_spark.llm.sharding import op4_sharding
from specimen_spark.llm.structure import op12_structure
from specimen_spark.llm.substring import OP7_SQL, op7_substring
from specimen_spark.llm.warc import op3_warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_ann": op6_ann,
    "op7_substring": op7_substring,
    "op8_chat": op8_chat,
    "op9_jaccard": op9_jaccard,
    "op10_linededup": op10_linededup,
    "op11_ppm": op11_ppm,
    "op12_structure": op12_structure,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op7_substring": OP7_SQL, "op9_jaccard": OP9_SQL, "op10_linededup": OP10_SQL}
