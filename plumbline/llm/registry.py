"""Queries of this subpackage and their SQL."""

from .chat import OP1_SQL, op1_chat
from .fingerprints import op4_fingerprints
from .jaccard import OP3_SQL, op3_jaccard
from .licences import OP9_SQL, op9_licences
from .mixing import OP10_SQL, op10_mixing
from .pieces import op7_pieces
from .quality import OP2_SQL, op2_quality
from .substring import OP6_SQL, op6_substring
from .suffix_dedup import op8_suffix
from .token_files import op5_token_files

QUERIES = {"op1_chat": op1_chat, "op2_quality": op2_quality, "op3_jaccard": op3_jaccard, "op4_fingerprints": op4_fingerprints, "op5_token_files": op5_token_files, "op6_substring": op6_substring, "op7_pieces": op7_pieces, "op8_suffix": op8_suffix, "op9_licences": op9_licences, "op10_mixing": op10_mixing}
ORACLES = {"op1_chat": OP1_SQL, "op2_quality": OP2_SQL, "op3_jaccard": OP3_SQL, "op6_substring": OP6_SQL, "op9_licences": OP9_SQL, "op10_mixing": OP10_SQL}
