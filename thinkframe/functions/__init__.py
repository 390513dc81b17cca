"""Column -> Column functions (string, regex, array work), all JVM-side.

Argument convention: *data* arguments (texts, answers, references, token
arrays, labels) take a column name or a ``Column``; *parameter* arguments
(tags, prefixes, benchmark names, system prompts) take a Python literal or a
``Column``. ``staged`` holds DataFrame-level forms of the heavier functions
that compute each intermediate once per row.
"""

from .text import (WS, WS_REGEX_CLASS, py_strip, find_last, split_think_answer,
                   whitespace_token_count)
from .grading import (last_boxed, normalize_math_answer, python_float, numeric_equal,
                      grade_math, grade_letter, grade)
from .formatting import (think_response, conversation_record,
                         format_question, dataset_key, run_name, parse_dataset_name,
                         iso_seconds, duration_text)
from .masking import response_start, char_to_token_index, think_mask
from .staged import (with_split_think_answer, with_last_boxed, with_grade_math, with_grade_letter,
                     with_grade, apply_think_mask)

__all__ = [
    "WS", "WS_REGEX_CLASS", "py_strip", "find_last", "split_think_answer",
    "whitespace_token_count", "last_boxed", "normalize_math_answer", "python_float",
    "numeric_equal", "grade_math", "grade_letter", "grade", "think_response",
    "conversation_record", "format_question", "dataset_key",
    "run_name", "parse_dataset_name", "iso_seconds", "duration_text",
    "response_start", "char_to_token_index", "think_mask", "with_split_think_answer", "with_last_boxed",
    "with_grade_math", "with_grade_letter", "with_grade", "apply_think_mask",
]
