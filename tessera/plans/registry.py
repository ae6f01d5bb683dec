"""Schemas and the catalogue of domains and datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_STRING, _BOOL = T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RECORD = _struct(instruction=_STRING, input=_STRING, output=_STRING, metadata=T.MapType(_STRING, _STRING))
CONTENT = _struct(
    strategy_suggestion=_STRING, partial_example=_STRING, feedback=_STRING, missed_concept=_STRING, brief_explanation=_STRING, key_attention_points=_STRING
)
ARTIFACT = _struct(target_objective=_STRING, skill_type=_STRING, cognitive_level=_STRING, failure_analysis=_STRING, scaffolding_content=CONTENT)
ROUND = _struct(iteration=T.IntegerType(), artifacts=T.ArrayType(ARTIFACT), summary=_STRING)
RESULT = _struct(
    id=_STRING,
    question_id=_STRING,
    instruction=_STRING,
    input=_STRING,
    output=_STRING,
    initial_response=_STRING,
    predicted_answer=_STRING,
    is_correct=_BOOL,
    scaffolding_correct=_BOOL,
    sft_case=_STRING,
    sft_response=_STRING,
    scaffolding_artifacts=T.ArrayType(ROUND),
    skip_reason=_STRING,
)
HISTORY = _struct(iteration=T.IntegerType(), role=_STRING, response=_STRING, evaluation=_STRING)
REFERENCES = _struct(iteration=T.IntegerType(), references=T.ArrayType(_STRING))
#: A row of a durable run: a result with what led to it.
RUN = T.StructType(
    [
        *RESULT.fields,
        *_struct(
            iterations_needed=T.IntegerType(),
            hot_count=T.LongType(),
            lot_count=T.LongType(),
            last_correct_iteration=T.IntegerType(),
            last_correct_response=_STRING,
            artifact_references=T.ArrayType(REFERENCES),
            conversation_history=T.ArrayType(HISTORY),
        ).fields,
    ]
)
LEGACY = _struct(
    id=_STRING, instruction=_STRING, input=_STRING, output=_STRING, sft_case=_STRING, phase1_correct=_BOOL, sft_response=_STRING, initial_response=_STRING
)

ANSWER_TYPES = ("mcq", "numeric", "latex", "text", "boolean")
#: Outcome names in logs, and what older logs called them.
CASE_A = "case_a_independent_performance_mastery"
CASE_B = "case_b_scaffolded_coached_mastery"
CASE_C = "case_c_teacher_modeling_distillation"
SKIPPED = "skipped"
LEGACY_CASES = {"A": CASE_A, "B": CASE_B, "C": CASE_C}


@dataclass(frozen=True)
class Domain:
    default_type: str
    train: dict[str, str]
    evaluate: dict[str, str]


#: Datasets and their answer types.
DOMAINS = {
    "math": Domain(
        "numeric",
        {"gsm8k": "numeric", "math": "latex"},
        {"gsm8k": "numeric", "math": "latex", "svamp": "numeric", "asdiv": "numeric", "mawps": "latex"},
    ),
    "logical": Domain("mcq", {"reclor": "mcq"}, {"reclor": "mcq", "anli_r2": "mcq", "anli_r3": "mcq", "bbh": "text"}),
    "commonsense": Domain("mcq", {"arc_c": "mcq"}, {"arc_c": "mcq", "strategyqa": "boolean", "openbookqa": "mcq"}),
}
#: Labels and configurations of the public datasets.
ANLI_LABELS = {0: "A", 1: "B", 2: "C"}
MATH_CONFIGS = ("algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus")
BBH_SUBTASKS = (
    "boolean_expressions",
    "formal_fallacies",
    "logical_deduction_three_objects",
    "logical_deduction_five_objects",
    "logical_deduction_seven_objects",
    "tracking_shuffled_objects_three_objects",
    "tracking_shuffled_objects_five_objects",
    "tracking_shuffled_objects_seven_objects",
    "web_of_lies",
)
PROMPTS = {
    "math": "Solve the problem step by step and put the final answer in \\boxed{}.",
    "mcq": "Choose the best option and put its letter in \\boxed{}.",
    "boolean": "Decide between Yes and No and put the answer in \\boxed{}.",
    "text": "Answer the question and put the answer in \\boxed{}.",
}
DEFAULT_INSTRUCTION = "Solve the following problem step by step."


def answer_type(domain: str, dataset: str) -> str:
    """A dataset's type, the domain's default where it is not listed."""
    held = DOMAINS[domain]
    return held.evaluate.get(dataset) or held.train.get(dataset) or held.default_type


def domain_of(dataset: str) -> str | None:
    return next((d for d, x in DOMAINS.items() if dataset in x.train or dataset in x.evaluate), None)


def datasets() -> list[str]:
    """Every dataset once, over training and evaluation."""
    return sorted({n for d in DOMAINS.values() for n in (*d.train, *d.evaluate)})


def short(model: str) -> str:
    return model.rsplit("/", 1)[-1]


def train_dir(base: str, domain: str, teacher: str, student: str) -> str:
    return f"{base}/{domain}/train/{short(teacher)}/{short(student)}"


def eval_dir(base: str, domain: str, student: str) -> str:
    return f"{base}/{domain}/eval/{short(student)}"


def enhanced_name(dataset: str, suffix: str = "_train_enhanced.json") -> str:
    """The name of an enriched file; other tools' endings are given as ``suffix``."""
    return dataset + suffix


def remote_model(name: str) -> bool:
    """Whether a model is reached over the network: no name, or a gpt one."""
    return not name or name.startswith("gpt-")
