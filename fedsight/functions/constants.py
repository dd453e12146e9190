"""Fixed values that must equal the reference's for equal results on its
clinical tables. They are the defaults of the feature operators; the test
tables use their own lists (see sources/testbed.py).
"""

# --- fixed values (clinical item ids, code lists, drug lists) -------------------
LAB_ITEMS = {
    "50912": "CREATININE", "50971": "POTASSIUM", "50983": "SODIUM",
    "50902": "CHLORIDE", "50882": "BICARBONATE", "51222": "HEMOGLOBIN",
    "51301": "WBC", "51265": "PLATELET", "50931": "GLUCOSE",
}
LAB_ITEMS_EXTRA = {"50960": "MAGNESIUM", "50893": "CALCIUM"}
VITAL_ITEMS = {
    "220045": "HEART_RATE", "220050": "SYSTOLIC_BP", "220051": "DIASTOLIC_BP",
    "220179": "TEMPERATURE", "220210": "RESPIRATORY_RATE", "220277": "SPO2",
}
CHARLSON_PREFIXES = {"MI": ["410", "412"], "CHF": ["428"], "Diabetes": ["250"]}
CHARLSON_CODES = {
    "MI": ["410", "412"],
    "CHF": ["398.91", "402.01", "402.11", "402.91", "404.01", "404.03", "404.11",
            "404.13", "404.91", "404.93", "425.4", "425.5", "425.7", "425.8",
            "425.9", "428"],
    "Diabetes": ["250.0", "250.1", "250.2", "250.3", "250.4", "250.5", "250.6",
                 "250.7", "250.8", "250.9"],
}
MEDICATION_CLASSES = {
    "ANTIBIOTIC": ["CEFAZOLIN", "VANCOMYCIN", "CEFTRIAXONE"],
    "CARDIAC": ["METOPROLOL", "ASPIRIN", "LISINOPRIL"],
    "ANALGESIC": ["MORPHINE", "ACETAMINOPHEN", "OXYCODONE"],
    "ANTICOAGULANT": ["HEPARIN", "WARFARIN"],
}
NA_TOKENS = ["", "nan", "NaN", "NULL"]
AGE_RANGE = (0, 120)
IQR_FACTOR = 3.0
CONTRIBUTION_DECAY = 0.7          # s <- 0.7*s + 0.3*auc
CONTRIBUTION_MISSING_AUC = 0.5
TEMPORAL_DECAY = 0.8
RBO_P = 0.9
ZSCORE_THRESHOLD = 2.0
TRIM_FRACTION = 0.1
PRIVACY_EPSILONS = [None, 10.0, 1.0, 0.5, 0.1]
DEFAULT_SENSITIVITY = 2.0
SEED = 42
