"""The regression models of the diffusion parameters, as data.

Each version names the parameters that vary (drift v, boundary a, non-decision
time t, starting point z) and the formula they vary by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from choicelab.functions.design import Factor
from choicelab.functions.formula import parse_formula

# Condition levels and regressor names of the trial table.
ABS = Factor("Abs_value", ("high_abs", "low_abs", "mid_abs"))
OV = Factor("OV_value", ("high_OV", "low_OV"))
PAIR = Factor("acceptance_pair", ("I", "M", "P"))
ABS_SIDE = Factor("Abs_Money_Pain", ("high_abs_h_money", "high_abs_h_pain", "low_abs_h_money", "low_abs_h_pain",
                                     "mid_abs"))
OV_SIDE = Factor("OV_Money_Pain", ("h_OV_h_money", "h_OV_h_pain", "low_OV_h_money", "low_OV_h_pain"))
PAIN, MONEY, BOTH = "sv_pain_para", "sv_money", "sv_both"
SCORES = ("STA_SAI_Score", "STA_TAI_Score", "PCS_Score")
ALL = "vtaz"

# Version, parameter and formula of every model; the plain model has no parameter.
ROWS = (
    (0, None, None),
    (1, "v", "v ~ 1 + sv_pain_para"),
    (2, "v", "v ~ 1 + sv_pain_para"),
    (2, "t", "t ~ 1 + sv_pain_para"),
    (2, "a", "a ~ 1 + sv_pain_para"),
    (2, "z", "z ~ 1 + sv_pain_para"),
    (3, "v", "v ~ 1 + sv_money"),
    (4, "v", "v ~ 1 + sv_money"),
    (4, "t", "t ~ 1 + sv_money"),
    (4, "a", "a ~ 1 + sv_money"),
    (4, "z", "z ~ 1 + sv_money"),
    (5, "t", "t ~ 1 + sv_pain_para"),
    (6, "a", "a ~ 1 + sv_pain_para"),
    (7, "t", "t ~ 1 + sv_money"),
    (8, "a", "a ~ 1 + sv_money"),
    (9, "v", "v ~ 1 + sv_pain_para + sv_money + sv_pain_para * sv_money"),
    (10, "v", "v ~ 1 + sv_pain_para + sv_money + sv_pain_para * sv_money"),
    (10, "t", "t ~ 1 + sv_pain_para + sv_money + sv_pain_para * sv_money"),
    (10, "a", "a ~ 1 + sv_pain_para + sv_money + sv_pain_para * sv_money"),
    (10, "z", "z ~ 1 + sv_pain_para + sv_money + sv_pain_para * sv_money"),
    (11, "v", "v ~ 1 + sv_pain_para + sv_money"),
    (12, "v", "v ~ 1 + sv_pain_para + sv_money"),
    (12, "t", "t ~ 1 + sv_pain_para + sv_money"),
    (12, "a", "a ~ 1 + sv_pain_para + sv_money"),
    (12, "z", "z ~ 1 + sv_pain_para + sv_money"),
    (13, "v", "v ~ 1 + sv_both"),
    (14, "v", "v ~ 1 + sv_both * sv_pain_para * sv_money"),
    (15, "v", "v ~ 1 + sv_both * sv_pain_para * sv_money"),
    (15, "t", "t ~ 1 + sv_both * sv_pain_para * sv_money"),
    (15, "a", "a ~ 1 + sv_both * sv_pain_para * sv_money"),
    (15, "z", "z ~ 1 + sv_both * sv_pain_para * sv_money"),
    (16, "v", "v ~ 1 + sv_pain_para:C(Abs_value)"),
    (17, "v", "v ~ 1 + sv_pain_para:C(OV_value)"),
    (18, "v", "v ~ 1 + sv_pain_para:C(Abs_Money_Pain)"),
    (19, "v", "v ~ 1 + sv_pain_para:C(OV_Money_Pain)"),
    (20, "v", "v ~ 0 + sv_pain_para:C(OV_Money_Pain):C(Abs_Money_Pain)"),
    (21, "v", "v ~ 0 + sv_pain_para:C(Abs_value):C(acceptance_pair)"),
    (22, "v", "v ~ 0 + sv_pain_para:C(OV_value):C(acceptance_pair)"),
    (23, "v", "v ~ 0 + sv_pain_para:C(OV_value):C(Abs_value)"),
    (24, "v", "v ~ 0 + sv_pain_para:C(OV_value):C(Abs_value):C(acceptance_pair)"),
    (25, "v", "v ~ 0 + sv_pain_para + C(OV_value) + C(acceptance_pair) + sv_pain_para:C(OV_value)"
            " + sv_pain_para:C(acceptance_pair) + C(OV_value):C(acceptance_pair)"
            " + sv_pain_para:C(OV_value):C(acceptance_pair)"),
    (26, "v", "v ~ 0 + sv_pain_para:C(Abs_value)"),
    (26, "t", "t ~ 0 + sv_pain_para:C(Abs_value)"),
    (26, "a", "a ~ 0 + sv_pain_para:C(Abs_value)"),
    (26, "z", "z ~ 0 + sv_pain_para:C(Abs_value)"),
    (27, "v", "v ~ 0 + sv_pain_para:C(OV_value)"),
    (27, "t", "t ~ 0 + sv_pain_para:C(OV_value)"),
    (27, "a", "a ~ 0 + sv_pain_para:C(OV_value)"),
    (27, "z", "z ~ 0 + sv_pain_para"),
    (28, "v", "v ~ 0 + sv_pain_para:C(OV_value):C(acceptance_pair)"),
    (28, "t", "t ~ 0 + sv_pain_para:C(OV_value):C(acceptance_pair)"),
    (28, "a", "a ~ 0 + sv_pain_para:C(OV_value):C(acceptance_pair)"),
    (28, "z", "z ~ 0 + sv_pain_para"),
    (29, "v", "v ~ 0 + sv_pain_para:C(Abs_value):C(acceptance_pair)"),
    (29, "t", "t ~ 0 + sv_pain_para:C(Abs_value):C(acceptance_pair)"),
    (29, "a", "a ~ 0 + sv_pain_para:C(Abs_value):C(acceptance_pair)"),
    (29, "z", "z ~ 0 + sv_pain_para"),
    (33, "v", "v ~ 0 + sv_pain_para:C(OV_value):C(acceptance_pair)"),
    (33, "a", "a ~ 0 + sv_pain_para:C(OV_value):C(acceptance_pair)"),
    (33, "t", "t ~ 0 + sv_pain_para"),
    (33, "z", "z ~ 0 + sv_pain_para:C(acceptance_pair)"),
    (34, "v", "v ~ 1 + STA_SAI_Score"),
    (35, "a", "a ~ 1 + STA_SAI_Score"),
    (36, "v", "v ~ 1 + STA_TAI_Score"),
    (37, "a", "a ~ 1 + STA_TAI_Score"),
    (38, "v", "v ~ 1 + PCS_Score"),
    (39, "a", "a ~ 1 + PCS_Score"),
    (40, "v", "v ~ 1 + STA_SAI_Score"),
    (40, "t", "t ~ 1 + STA_SAI_Score"),
    (40, "a", "a ~ 1 + STA_SAI_Score"),
    (40, "z", "z ~ 1 + STA_SAI_Score"),
    (41, "v", "v ~ 1 + STA_TAI_Score"),
    (41, "t", "t ~ 1 + STA_TAI_Score"),
    (41, "a", "a ~ 1 + STA_TAI_Score"),
    (41, "z", "z ~ 1 + STA_TAI_Score"),
    (42, "v", "v ~ 1 + PCS_Score"),
    (42, "t", "t ~ 1 + PCS_Score"),
    (42, "a", "a ~ 1 + PCS_Score"),
    (42, "z", "z ~ 1 + PCS_Score"),
    (43, "v", "v ~ 0 + STA_SAI_Score:sv_pain_para:C(OV_value)"),
    (43, "t", "t ~ 0 + STA_SAI_Score:sv_pain_para:C(OV_value)"),
    (43, "a", "a ~ 0 + STA_SAI_Score:sv_pain_para:C(OV_value)"),
    (43, "z", "z ~ 0 + STA_SAI_Score:sv_pain_para:C(OV_value)"),
    (44, "v", "v ~ 0 + STA_TAI_Score:sv_pain_para:C(OV_value)"),
    (44, "t", "t ~ 0 + STA_TAI_Score:sv_pain_para:C(OV_value)"),
    (44, "a", "a ~ 0 + STA_TAI_Score:sv_pain_para:C(OV_value)"),
    (44, "z", "z ~ 0 + STA_TAI_Score:sv_pain_para:C(OV_value)"),
    (45, "v", "v ~ 0 + PCS_Score:sv_pain_para:C(OV_value)"),
    (45, "t", "t ~ 0 + PCS_Score:sv_pain_para:C(OV_value)"),
    (45, "a", "a ~ 0 + PCS_Score:sv_pain_para:C(OV_value)"),
    (45, "z", "z ~ 0 + PCS_Score:sv_pain_para:C(OV_value)"),
    (46, "v", "v ~ 0 + STA_SAI_Score:sv_pain_para:C(Abs_value)"),
    (46, "t", "t ~ 0 + STA_SAI_Score:sv_pain_para:C(Abs_value)"),
    (46, "a", "a ~ 0 + STA_SAI_Score:sv_pain_para:C(Abs_value)"),
    (46, "z", "z ~ 0 + STA_SAI_Score:sv_pain_para:C(Abs_value)"),
    (47, "v", "v ~ 0 + STA_TAI_Score:sv_pain_para:C(Abs_value)"),
    (47, "t", "t ~ 0 + STA_TAI_Score:sv_pain_para:C(Abs_value)"),
    (47, "a", "a ~ 0 + STA_TAI_Score:sv_pain_para:C(Abs_value)"),
    (47, "z", "z ~ 0 + STA_TAI_Score:sv_pain_para:C(Abs_value)"),
    (48, "v", "v ~ 0 + PCS_Score:sv_pain_para:C(Abs_value)"),
    (48, "t", "t ~ 0 + PCS_Score:sv_pain_para:C(Abs_value)"),
    (48, "a", "a ~ 0 + PCS_Score:sv_pain_para:C(Abs_value)"),
    (48, "z", "z ~ 0 + PCS_Score:sv_pain_para:C(Abs_value)"),
    (49, "v", "v ~ 0 + STA_SAI_Score:sv_pain_para:C(acceptance_pair)"),
    (49, "t", "t ~ 0 + STA_SAI_Score:sv_pain_para:C(acceptance_pair)"),
    (49, "a", "a ~ 0 + STA_SAI_Score:sv_pain_para:C(acceptance_pair)"),
    (49, "z", "z ~ 0 + STA_SAI_Score:sv_pain_para:C(acceptance_pair)"),
    (50, "v", "v ~ 0 + STA_TAI_Score:sv_pain_para:C(acceptance_pair)"),
    (50, "t", "t ~ 0 + STA_TAI_Score:sv_pain_para:C(acceptance_pair)"),
    (50, "a", "a ~ 0 + STA_TAI_Score:sv_pain_para:C(acceptance_pair)"),
    (50, "z", "z ~ 0 + STA_TAI_Score:sv_pain_para:C(acceptance_pair)"),
    (51, "v", "v ~ 0 + PCS_Score:sv_pain_para:C(acceptance_pair)"),
    (51, "t", "t ~ 0 + PCS_Score:sv_pain_para:C(acceptance_pair)"),
    (51, "a", "a ~ 0 + PCS_Score:sv_pain_para:C(acceptance_pair)"),
    (51, "z", "z ~ 0 + PCS_Score:sv_pain_para:C(acceptance_pair)"),
    (52, "v", "v ~ 1 + sv_pain_para * STA_SAI_Score + sv_pain_para * STA_TAI_Score + sv_pain_para * PCS_Score"
            " + sv_pain_para * STA_SAI_Score * STA_TAI_Score * PCS_Score"),
    (53, "v", "v ~ 1 + sv_pain_para * STA_SAI_Score + sv_pain_para * STA_TAI_Score + sv_pain_para * PCS_Score"
            " + sv_pain_para * STA_SAI_Score * STA_TAI_Score * PCS_Score"),
    (53, "t", "t ~ 1 + sv_pain_para * STA_SAI_Score + sv_pain_para * STA_TAI_Score + sv_pain_para * PCS_Score"
            " + sv_pain_para * STA_SAI_Score * STA_TAI_Score * PCS_Score"),
    (53, "a", "a ~ 1 + sv_pain_para * STA_SAI_Score + sv_pain_para * STA_TAI_Score + sv_pain_para * PCS_Score"
            " + sv_pain_para * STA_SAI_Score * STA_TAI_Score * PCS_Score"),
    (53, "z", "z ~ 1 + sv_pain_para * STA_SAI_Score + sv_pain_para * STA_TAI_Score + sv_pain_para * PCS_Score"
            " + sv_pain_para * STA_SAI_Score * STA_TAI_Score * PCS_Score"),
    (54, "v", "v ~ 1 + STA_SAI_Score * (sv_both * sv_pain_para * sv_money)"),
    (54, "t", "t ~ 1 + STA_SAI_Score * (sv_both * sv_pain_para * sv_money)"),
    (54, "a", "a ~ 1 + STA_SAI_Score * (sv_both * sv_pain_para * sv_money)"),
    (54, "z", "z ~ 1 + STA_SAI_Score * (sv_both * sv_pain_para * sv_money)"),
    (55, "v", "v ~ 1 + STA_TAI_Score * sv_both * sv_pain_para * sv_money"),
    (55, "t", "t ~ 1 + STA_TAI_Score * sv_both * sv_pain_para * sv_money"),
    (55, "a", "a ~ 1 + STA_TAI_Score * sv_both * sv_pain_para * sv_money"),
    (55, "z", "z ~ 1 + STA_TAI_Score * sv_both * sv_pain_para * sv_money"),
    (56, "v", "v ~ 1 + PCS_Score * sv_both * sv_pain_para * sv_money"),
    (56, "t", "t ~ 1 + PCS_Score * sv_both * sv_pain_para * sv_money"),
    (56, "a", "a ~ 1 + PCS_Score * sv_both * sv_pain_para * sv_money"),
    (56, "z", "z ~ 1 + PCS_Score * sv_both * sv_pain_para * sv_money"),
)


LEVELS = {f.name: f.levels for f in (ABS, OV, PAIR, ABS_SIDE, OV_SIDE)}


def _models() -> dict[int, dict]:
    """Version -> parameter -> (intercept, terms)."""
    models: dict[int, dict] = {}
    for version, param, text in ROWS:
        of_version = models.setdefault(version, {})
        if param:
            _, *of_version[param] = parse_formula(text, LEVELS)
    return models


MODELS = _models()


def model_catalog(spark: SparkSession) -> DataFrame:
    """(version, parameter, formula); the plain model has one row without parameter."""
    return spark.createDataFrame(list(ROWS), "version int, parameter string, formula string")
