"""Mixture profiles: declarative lists of tasks with slices and weights.

A profile is data. ``build_profile`` takes a function that loads a task table by name and
option, so the same lists run on any storage; parts marked optional are left out when their
table cannot be loaded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from tokenmill.operators.mixing import Task, mixture, phase_weight, slice_task

# Rows held out of train-only tasks for validation.
CHAT_DEV, GSM_DEV, MATH_DEV = 24000, 420, 100

# Subjects of the competition-math task.
MATH_SUBJECTS = (
    "algebra", "counting_and_probability", "geometry", "intermediate_algebra",
    "number_theory", "prealgebra", "precalculus",
)

# The subjects of the multi-subject question set.
SUBJECTS = (
    "abstract_algebra", "anatomy", "astronomy", "business_ethics", "clinical_knowledge", "college_biology",
    "college_chemistry", "college_computer_science", "college_mathematics", "college_medicine", "college_physics",
    "computer_security", "conceptual_physics", "econometrics", "electrical_engineering", "elementary_mathematics",
    "formal_logic", "global_facts", "high_school_biology", "high_school_chemistry", "high_school_computer_science",
    "high_school_european_history", "high_school_geography", "high_school_government_and_politics",
    "high_school_macroeconomics", "high_school_mathematics", "high_school_microeconomics", "high_school_physics",
    "high_school_psychology", "high_school_statistics", "high_school_us_history", "high_school_world_history",
    "human_aging", "human_sexuality", "international_law", "jurisprudence", "logical_fallacies", "machine_learning",
    "management", "marketing", "medical_genetics", "miscellaneous", "moral_disputes", "moral_scenarios", "nutrition",
    "philosophy", "prehistory", "professional_accounting", "professional_law", "professional_medicine",
    "professional_psychology", "public_relations", "security_studies", "sociology", "us_foreign_policy", "virology",
    "world_religions",
)

# Subject groups that can be up-weighted.
SUBJECT_GROUPS = {
    "physics": ["astronomy", "college_physics", "conceptual_physics", "high_school_physics"],
    "biology": ["anatomy", "college_biology", "high_school_biology", "medical_genetics",
                "nutrition", "virology"],
    "engineering": ["electrical_engineering"],
    "cs": ["college_computer_science", "high_school_computer_science", "machine_learning"],
    "it": ["computer_security"],
}

# Reasoning sets of the benchmark profile.
REASONING_SETS = (
    "gsm8k-platinum", "gsm8k-567", "hendrycks-math-benchmark", "math_qa", "calc-svamp",
    "math-augmented", "aqua-rat-mcqa", "logiqa", "social-iqa", "qasc",
)


# Subsets of the function-call benchmark, and those whose answers are stored apart.
CALL_COLLECTIONS = {
    "all": [
        "exec_simple", "exec_parallel", "exec_multiple", "exec_parallel_multiple", "simple", "irrelevance",
        "parallel", "multiple", "parallel_multiple", "java", "javascript", "rest", "live_simple", "live_multiple",
        "live_parallel", "live_parallel_multiple", "live_irrelevance", "live_relevance", "multi_turn_base",
        "multi_turn_miss_func", "multi_turn_miss_param", "multi_turn_long_context", "multi_turn_composite",
    ],
    "multi_turn": [
        "multi_turn_base", "multi_turn_miss_func", "multi_turn_miss_param", "multi_turn_long_context",
        "multi_turn_composite",
    ],
    "single_turn": [
        "exec_simple", "exec_parallel", "exec_multiple", "exec_parallel_multiple", "simple", "irrelevance",
        "parallel", "multiple", "parallel_multiple", "java", "javascript", "rest", "live_simple", "live_multiple",
        "live_parallel", "live_parallel_multiple", "live_irrelevance", "live_relevance",
    ],
    "live": [
        "live_simple", "live_multiple", "live_parallel", "live_parallel_multiple", "live_irrelevance",
        "live_relevance",
    ],
    "non_live": [
        "exec_simple", "exec_parallel", "exec_multiple", "exec_parallel_multiple", "simple", "irrelevance",
        "parallel", "multiple", "parallel_multiple", "java", "javascript", "rest",
    ],
    "executable": [
        "exec_simple", "exec_parallel", "exec_multiple", "exec_parallel_multiple", "rest",
    ],
    "non_python": [
        "java", "javascript",
    ],
    "python": [
        "exec_simple", "exec_parallel", "exec_multiple", "exec_parallel_multiple", "simple", "irrelevance",
        "parallel", "multiple", "parallel_multiple", "rest", "live_simple", "live_multiple", "live_parallel",
        "live_parallel_multiple", "live_irrelevance", "live_relevance",
    ],
}
CALL_ANSWERS = {
    "simple", "multiple", "parallel", "parallel_multiple", "java", "javascript", "sql", "live_simple",
    "live_multiple", "live_parallel", "live_parallel_multiple", "multi_turn_base", "multi_turn_miss_func",
    "multi_turn_miss_param", "multi_turn_long_context", "multi_turn_composite",
}


def call_files(collection: str = "all") -> dict[str, tuple[str, str | None]]:
    """Item file and answer file of each subset of a function-call collection."""
    if collection not in CALL_COLLECTIONS:
        raise ValueError(f"Unknown collection {collection!r}. Available: {sorted(CALL_COLLECTIONS)}")
    name = lambda s: f"BFCL_v3_{s}.json"
    return {
        s: (name(s), f"possible_answer/{name(s)}" if s in CALL_ANSWERS else None)
        for s in CALL_COLLECTIONS[collection]
    }


@dataclass(frozen=True)
class Part:
    """One entry of a profile."""

    name: str
    options: dict = field(default_factory=dict)
    start: int = 0
    stop: int | None = None
    weight: str | None = None
    optional: bool = False


def default_train() -> list[Part]:
    return [
        Part("smoltalk", {"split": "train"}, start=CHAT_DEV),
        Part("alpaca", {"split": "train"}),
        Part("mmlu", {"subset": "auxiliary_train", "split": "train"}),
        Part("gsm8k", {"subset": "main", "split": "train"}, start=GSM_DEV),
        Part("identity"),
        Part("identity"),
        Part("simple_spelling", {"size": 200000, "split": "train"}),
        Part("spelling", {"size": 80000, "split": "train"}),
    ]


def benchmarks_train() -> list[Part]:
    return [
        Part("smoltalk", {"split": "train"}, start=CHAT_DEV, stop=CHAT_DEV + 200000),
        Part("alpaca", {"split": "train"}),
        Part("open_thoughts", {"split": "train"}, stop=200000),
        Part("skunkworks", {"split": "train"}),
        Part("magpie", {"split": "train"}, stop=150000),
        Part("natural_reasoning", {"split": "train"}, stop=50000),
        Part("mmlu", {"subset": "auxiliary_train", "split": "train"}, weight="mmlu"),
        *[
            Part("mmlu_subjects", {"group": g, "split": "train"}, weight=f"mmlu_{g}", optional=True)
            for g in SUBJECT_GROUPS
        ],
        Part("arc", {"subset": "ARC-Challenge", "split": "train"}, weight="arc"),
        Part("arc", {"subset": "ARC-Easy", "split": "train"}, weight="arc"),
        Part("hellaswag", {"split": "train"}, weight="hellaswag"),
        Part("sciq", {"split": "train"}),
        Part("openbookqa", {"split": "train"}),
        Part("gpqa", {"subset": "gpqa_main", "split": "train"}, weight="gpqa", optional=True),
        Part("gsm8k", {"subset": "main", "split": "train"}, start=GSM_DEV, weight="gsm8k"),
        Part("open_math_instruct", {"split": "train"}, stop=200000),
        Part("numina_math", {"split": "train"}, stop=200000),
        Part("aime", {"year": 2024, "split": "train"}),
        Part("aime", {"year": 2025, "split": "train"}),
        *[
            Part("hendrycks_math", {"subject": s, "split": "train"}, start=MATH_DEV, weight="hendrycks")
            for s in MATH_SUBJECTS
        ],
        *[Part(name, {"split": "train"}, optional=True) for name in REASONING_SETS],
        Part("xlam", {"split": "train"}, optional=True),
        Part("hermes", {"subset": "func-calling-singleturn", "split": "train"}),
        Part("hermes", {"subset": "glaive-function-calling-5k", "split": "train"}),
        Part("function_calling_sharegpt", {"split": "train"}, stop=80000),
        Part("triviaqa", {"subset": "unfiltered", "split": "train"}, stop=50000, weight="triviaqa"),
        Part("identity"),
        Part("identity"),
        Part("simple_spelling", {"size": 200000, "split": "train"}),
        Part("spelling", {"size": 80000, "split": "train"}),
    ]


def default_val() -> list[Part]:
    return [
        Part("smoltalk", {"split": "train"}, stop=CHAT_DEV),
        Part("mmlu", {"subset": "all", "split": "dev"}),
        Part("gsm8k", {"subset": "main", "split": "train"}, stop=GSM_DEV),
    ]


def benchmarks_val() -> list[Part]:
    return [
        Part("arc", {"subset": "ARC-Challenge", "split": "test"}),
        Part("arc", {"subset": "ARC-Easy", "split": "test"}),
        Part("hellaswag", {"split": "validation"}),
        Part("mmlu", {"subset": "all", "split": "test"}),
        Part("mmlu_pro", {"split": "test"}),
        Part("gsm8k", {"subset": "main", "split": "test"}),
        *[Part("hendrycks_math", {"subject": s, "split": "test"}) for s in MATH_SUBJECTS],
        Part("humaneval"),
        Part("triviaqa", {"subset": "unfiltered", "split": "validation"}),
        Part("hle", {"split": "test"}),
    ]


def benchmark_eval() -> list[Part]:
    return [
        Part("arc", {"subset": "ARC-Challenge", "split": "test"}, optional=True),
        Part("arc", {"subset": "ARC-Easy", "split": "test"}, optional=True),
        Part("mmlu", {"subset": "all", "split": "test"}, optional=True),
        Part("mmlu_pro", {"split": "test"}, optional=True),
        Part("gsm8k", {"subset": "main", "split": "test"}, optional=True),
        *[
            Part("hendrycks_math", {"subject": s, "split": "test"}, optional=True)
            for s in MATH_SUBJECTS
        ],
        Part("humaneval", optional=True),
        Part("hle", {"split": "test"}, optional=True),
        Part("bfcl", optional=True),
    ]


PROFILES = {
    "default": default_train,
    "benchmarks": benchmarks_train,
    "both": lambda: default_train() + benchmarks_train(),
    "default_val": default_val,
    "benchmarks_val": benchmarks_val,
    "both_val": lambda: default_val() + benchmarks_val(),
    "benchmark_eval": benchmark_eval,
}


def profile_tasks(
    parts: Sequence[Part],
    load: Callable[..., DataFrame],
    weights: dict[str, int] | None = None,
    phase2: bool = False,
    multiplier: int = 1,
) -> list[Task]:
    """Load, slice and weight the parts.

    A subject-group part adds only copies beyond the first, since the base task holds one.
    """
    tasks = []
    for part in parts:
        times = phase_weight((weights or {}).get(part.weight, 1), multiplier, phase2)
        if not part.weight:
            times = 1
        if part.name == "mmlu_subjects":
            times -= 1
            if times < 1:
                continue
        try:
            rows = load(part.name, **part.options)
            rows.schema
        except (PySparkException, LookupError, OSError, ValueError):
            if part.optional:
                continue
            raise
        if part.start or part.stop is not None:
            rows = slice_task(rows, part.start, part.stop)
        tasks.append(Task(part.name, rows, repeats=times))
    return tasks


def build_profile(
    name: str, load: Callable[..., DataFrame], weights=None, phase2=False, multiplier=1, seed=42
) -> DataFrame:
    if name not in PROFILES:
        raise ValueError(f"Unknown profile {name!r}. Available: {sorted(PROFILES)}")
    return mixture(profile_tasks(PROFILES[name](), load, weights, phase2, multiplier), seed)
