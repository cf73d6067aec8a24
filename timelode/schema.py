"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

EVENTS = "patient_id long, event_idx int, start_time timestamp_ntz, end_time timestamp_ntz, code string, value string, unit string, omop_table string, visit_id long"
LABELS = "patient_id long, prediction_time timestamp_ntz, label_type string, bool_value boolean, int_value int, float_value double, tte interval day to second, is_censored boolean"
LABEL_FILE = "patient_id long, prediction_time timestamp_ntz, value string, label_type string"
SURVIVAL_FILE = LABEL_FILE + ", is_censored boolean"
SPLITS = "split string, omop_person_id long"
EDGES = "parent string, child string"
RESULTS = "labeling_function string, sub_task string, model string, head string, replicate int, k int, score string, value double, std double, lower double, mean double, upper double, model_hparams string"
PREDS = "labeling_function string, sub_task string, model string, head string, replicate int, k int, patient_id long, prediction_time timestamp_ntz, y int, pred_proba double, split string"

#: The fourteen findings of a chest film, most significant bit first.
CHEST_FINDINGS = [
    "No Finding",
    "Enlarged Cardiomediastinum",
    "Cardiomegaly",
    "Lung Lesion",
    "Lung Opacity",
    "Edema",
    "Consolidation",
    "Pneumonia",
    "Atelectasis",
    "Pneumothorax",
    "Pleural Effusion",
    "Pleural Other",
    "Fracture",
    "Support Devices",
]
CHEST_TSV = "patient_id long, start string, " + ", ".join(f"`{c}` double" for c in CHEST_FINDINGS)
