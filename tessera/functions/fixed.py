"""Word lists, patterns, tables and constants that results depend on."""

# Tokens of the lexical index, their stop words, suffixes and folded letters.
TOKEN = "[a-zA-ZäöüÄÖÜß0-9§]+"
STOP_WORDS = """
der die das den dem des ein eine einen einem einer eines und oder aber ist sind war waren
sein bei in im an auf für fur mit von vom zu zur zum aus nach über uber unter vor wie was
wer wo wann warum welche welcher welches wird werden kann können konnen muss müssen mussen
soll sollen ich du er sie es wir ihr man nicht kein keine als auch noch nur schon dass ob
am ist sich so wenn dann hier da
the a an is are was were be of to in on at for with and or how what when where why which who
this that it i you we they not no do does
""".split()
SUFFIXES = ["ern", "en", "er", "es", "e", "n", "s"]
LEAST_STEM = 4

# BM25, result sizes, confidence, chunk budgets.
BM25_K1, BM25_B = 1.5, 0.75
TOP_RECALL, TOP_FINAL, EVAL_K, LEAST_SCORE = 50, 6, 5, 0.2
CHUNK_TOKENS, CHUNK_OVERLAP, CHARS_A_TOKEN = 400, 64, 4
SUMMARY_CHARS = 240
STUB_SUMMARY = "Kein eindeutiger Treffer in den Versicherungsbedingungen. Keine Deckungszusage geben; einem Spezialisten zur Bestätigung übergeben."

# Structure markers of a corpus document.
MARKER = r"§\s*\d+[a-z]?|Teil\s+[A-Z0-9]+|\d+(?:\.\d+)*\s+\S"
CONTAINER, CONTAINER_CHARS = "Teil", 80

# Redaction rules, in the order in which they are applied.
REDACTIONS = [
    ("DOB", r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b", "[DOB]"),
    ("POLICY", r"\b[A-Z]{2}-[A-Z]{2,4}-\d{4}-\d{4,8}\b", "[POLICY]"),
    ("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", "[VIN]"),
    ("IBAN", r"\bDE\d{2}[\s\-]?(?:\d{4}[\s\-]?){4}\d{2}\b", "[IBAN]"),
    ("SVNR", r"\b\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}\b", "[SVNR]"),
    ("HEALTH_CARD", r"\b[A-Z]\d{9,10}\b", "[HEALTH_CARD]"),
    ("DL", r"\b(?=[A-Z0-9]{10,12}\b)(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*\d)[A-Z0-9]{10,12}\b", "[DL]"),
    ("CARD", r"\b(?:\d[ \-]?){13,19}\b", "[CARD]"),
    ("CARD16", r"\b\d{16}\b", "[CARD]"),
    ("PLATE", r"\b[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}\s?\d{1,4}\b", "[PLATE]"),
    ("EMAIL", r"\b[\w.\-]+@[\w.\-]+\.\w{2,}\b", "[EMAIL]"),
    ("PHONE", r"\+?\d{1,3}[\s\-]?\d{2,5}[\s\-]?\d{2,4}(?:[\s\-]?\d{2,5})?", "[PHONE]"),
]

# Extraction rules (kind, label, pattern, group, constant value or None, score, case-insensitive),
# in the order that breaks ties between equal scores.
HEALTH_CLAIM = r"\b(health|medical|illness|sick|Krankenkasse|Krankenversicherung|Gesundheit|fracture|surgery|doctor|hospital|clinic|injury|injured)\b"
AUTO_CLAIM = r"\b(car|auto|vehicle|automobile|accident|crash|collision|KFZ|Unfall|Fahrzeug|motor)\b"
HOSPITAL = r"\b(hospital|clinic|medical\s+cent(?:er|re)|Krankenhaus|Klinik|ER|emergency\s+room|Notaufnahme)\b"
EXTRACTIONS = [
    ("pillar", "claim_type", HEALTH_CLAIM, 0, "health", 0.85, True),
    ("pillar", "claim_type", AUTO_CLAIM, 0, "auto", 0.65, True),
    ("pillar", "incident_datetime", r"\b(\d{1,2}[./]\d{1,2}[./]\d{2,4}|today|yesterday|last\s+\w+day)\b", 1, None, 0.72, True),
    ("pillar", "incident_datetime", r"\b(\d{1,2}:\d{2}(?:\s*[ap]m)?)\b", 1, None, 0.68, True),
    ("pillar", "incident_location", r"\b(A\d{1,3}|B\d{1,3}|Autobahn|[A-Z][a-z]+(straße|strasse|street|road|avenue|ave|blvd|platz|gasse))\b", 0, None, 0.75, True),
    ("pillar", "incident_location", r"\b(Berlin|München|Munich|Hamburg|Frankfurt|Köln|Cologne|Stuttgart|Düsseldorf|Leipzig|Dortmund|Essen|Bremen|Dresden|Hannover)\b", 0, None, 0.60, True),
    ("pillar", "incident_location", HOSPITAL, 0, None, 0.65, True),
    ("pillar", "injuries_or_symptoms", r"\b(whiplash|fracture|broken|bleeding|concussion|bruise|burn|sprain|chest\s+pain|headache|fever|nausea|dizziness|surgery|ambulance|hurt|pain|injured|Schmerz|verletzt|Kopfschmerzen|Fieber)\b", 0, None, 0.78, True),
    ("pillar", "how_it_happened", r"\b(crashed|hit|collided|fell|slipped|tripped|broke|started\s+to\s+pain|attack|seizure|emergency|accident|incident|Unfall|Sturz|Schmerzen)\b", 0, None, 0.65, True),
    ("pillar", "incident_datetime", r"\b(just\s+now|a\s+moment\s+ago|an\s+hour\s+ago|\d+\s+minutes\s+ago|this\s+morning|last\s+night|today|yesterday)\b", 0, None, 0.60, True),
    ("pillar", "treatment_received", r"\b(surgery|operation|stitches|X-?ray|MRI|CT\s+scan|medication|prescription|physiotherapy|rehab|treatment|Behandlung|Operation|Medikament)\b", 0, None, 0.72, True),
    ("pillar", "provider_name", r"\bDr\.?\s+[A-Z][a-z]+\b|\b(doctor|physician|specialist|surgeon|GP|general\s+practitioner)\b", 0, None, 0.80, True),
    ("pillar", "provider_name", HOSPITAL, 0, None, 0.68, True),
    ("pillar", "other_party_plate", r"\b([A-ZÄÖÜ]{1,3}[-\s][A-Z]{1,2}\s?\d{1,4})\b", 1, None, 0.85, False),
    ("pillar", "vehicle_drivable", r"\b(not\s+drivable|cannot\s+drive|totaled?|write[-\s]off|kann\s+nicht\s+fahren|Totalschaden)\b", 0, "no", 0.80, True),
    ("pillar", "vehicle_drivable", r"\b(still\s+drivable|still\s+drives?|drove\s+home|fahrtüchtig)\b", 0, "yes", 0.75, True),
    ("pillar", "settlement_preference", r"\b(repair\s+shop|body\s+shop|reimburs|direct\s+payment|Werkstatt|Erstattung)\b", 0, None, 0.65, True),
    ("pillar", "police_or_ambulance", r"\b(police|Polizei|cops|officers?)\b", 0, "police", 0.78, True),
    ("pillar", "police_or_ambulance", r"\b(ambulance|paramedic|Rettungswagen|Notarzt)\b", 0, "ambulance", 0.80, True),
    ("pillar", "police_case_number", r"\b(?:case|reference|report)\s*(?:number|no\.?|#)?\s*[:#]?\s*(\w{4,})\b", 1, None, 0.82, True),
    ("pillar", "fault_admission", r"\b(my fault|their fault|I caused|they caused|ran the red|Schuld|verschuldet)\b", 0, None, 0.78, True),
    ("pillar", "witnesses", r"\b(witness(?:es)?|bystander|passerby|Zeuge)\b", 0, None, 0.65, True),
    ("fraud", "delayed_reporting", r"\b(\d+)\s+(weeks?|months?|days?)\s+ago\b", 0, None, 0.70, True),
]

# Emotion patterns, tried in this order on lower-case text; calm otherwise.
EMOTIONS = [
    ("distressed", r"\b(pain|hurt|emergency|scared|help|please|crying|ambulance|bleeding|broken|dying|shaking|frightened|chest\s+pain|headache|fracture|surgery|terrible|suffering|agonizing|painful|sick|hurt|injured)\b"),
    ("noisy", r"\b(can't\s+hear|loud|background|noise|static|interference|wind|highway|traffic|bad\s+connection|breaking\s+up|echo)\b"),
]

# Questions that ask for a pillar.
INTENTS = {
    "injuries": [r"\b(are|is)\s+(you|anyone|anybody)\b.*\b(ok|okay|alright|hurt|injur)", r"\bany(one|body)?\s+(hurt|injur)", r"\bambulance\b", r"\b(physical(ly)?\s+)?(ok|okay|alright)\b\??"],
    "accident_datetime": [r"\bwhen\s+(did|was|exactly)\b", r"\bwhat\s+time\b", r"\bhow\s+long\s+ago\b"],
    "accident_location": [r"\bwhere\s+(were|are|did|exactly|was|the)\b", r"\bwhich\s+(road|street|exit|address|location)\b", r"\b(road|street|address)\s+name\b"],
    "road_type": [r"\b(autobahn|motorway|highway|city street|parking lot|country road)\b\??", r"\bwhat\s+kind\s+of\s+road\b"],
    "how_it_happened": [r"\bwalk\s+me\s+through\b", r"\b(what|how)\s+happened\b", r"\b(in|describe).*\bown\s+words\b", r"\bcan\s+you\s+(tell|describe)\b"],
    "vehicle_drivable": [r"\bdriv(able|e\s+(it|the\s+car))\b\??", r"\bcan\s+you\s+(still\s+)?drive\b", r"\b(need|want)\s+a\s+tow\b", r"\btow(ed|ing)\b\??", r"\bwhere\s+is\s+the\s+(car|vehicle)\s+now\b"],
    "other_party_involved": [r"\b(another|other)\s+(vehicle|car|driver|party)\b\??", r"\b(any(one|body))\s+else\s+involved\b", r"\bthird\s+party\b"],
    "other_party_plate": [r"\b(other|their)\s+(party|driver|car).{0,12}(plate|license)", r"\b(do|did)\s+you\s+(have|get|catch).{0,12}plate\b", r"\bplate\s+number\b"],
    "other_party_insurer": [r"\b(their|other party'?s?|other driver'?s?)\s+(insurer|insurance)\b", r"\bwho\s+(do they|are they)\s+insured\s+with\b", r"\bwhich\s+insurer\b"],
    "police_involved": [r"\b(were\s+|did\s+|was\s+)?(the\s+)?police\s+(called|involved|on\s+scene|come)\b", r"\bdid\s+you\s+call\s+(the\s+)?police\b", r"\bpolice\s+show(ed|ing)?\s+up\b"],
    "police_case_number": [r"\b(police\s+)?(case|reference|file|incident)\s+number\b", r"\b(do\s+you\s+have|got)\s+a?\s*(case|reference)\b"],
    "witnesses": [r"\bany\s+witness(es)?\b", r"\b(was\s+there|were\s+there|did\s+anyone)\s+(see|witness)"],
    "driver_identity": [r"\bwho\s+(was|were)\s+(the\s+)?driv(ing|er)\b", r"\bwere\s+you\s+(the\s+one\s+)?driv(ing|er)\b", r"\bbehind\s+the\s+wheel\b"],
    "fault_admission": [r"\b(any\s+)?(one|body)\s+admit(ted)?\s+fault\b", r"\bwhose\s+fault\b", r"\bsay(ing)?\s+anything\s+about\s+fault\b"],
    "settlement_preference": [r"\b(preferred|favourite)\s+(repair\s+shop|garage|workshop)\b", r"\b(rental\s+car|loss[\s\-]of[\s\-]use)\b\??", r"\bwhich\s+(garage|workshop|shop)\b"],
}

# The pillars of a claim with what is asked for, and the fraud signals.
PILLARS = [
    ("claim_type", "is this an auto, health, or medical claim?"),
    ("incident_datetime", "when did the incident or medical event occur (date + time)"),
    ("incident_location", "where (address, hospital, clinic, or road name)"),
    ("injuries_or_symptoms", "description of injuries or health symptoms"),
    ("how_it_happened", "free-form description of the incident or medical issue"),
    ("treatment_received", "what medical treatment was received (if health claim)"),
    ("provider_name", "name of doctor or hospital (if health claim)"),
    ("vehicle_drivable", "is the car drivable (if auto claim)"),
    ("other_party_involved", "was anyone else involved (other driver, doctor, etc.)"),
    ("police_or_ambulance", "was police or ambulance called?"),
    ("witnesses", "independent witnesses (if auto claim)"),
    ("fault_admission", "anything said about fault at the scene (if auto claim)"),
    ("settlement_preference", "preferred repair shop or reimbursement method"),
]
FRAUD_SIGNALS = ["delayed_reporting", "known_to_other_party", "vehicle_listed_for_sale", "prior_similar_incident", "timeline_inconsistency"]

# Pillars that count for progress, for every claim and by type; words of a claim type's value.
COMMON_PILLARS = ["claim_type", "incident_datetime", "incident_location", "injuries_or_symptoms", "how_it_happened"]
AUTO_PILLARS = ["vehicle_drivable", "other_party_involved", "police_or_ambulance", "witnesses", "fault_admission", "settlement_preference"]
HEALTH_PILLARS = ["treatment_received", "provider_name", "police_or_ambulance", "settlement_preference"]
HEALTH_WORDS, AUTO_WORDS = ["health", "medical", "gesundheit"], ["auto", "car", "vehicle", "kfz"]

# Severity weights of the risk score and of the gauge, their cap and the gauge's bands.
RISK_WEIGHTS = {"low": 1, "medium": 2, "high": 4}
GAUGE_WEIGHTS = {"low": 1.0, "medium": 2.5, "high": 5.0}
RISK_CAP, HIGH_RISK, MODERATE_RISK = 10, 7, 4

# Human labels of a model and aliases of older labels.
HUMAN_LABELS = {
    "claim type": "claim_type", "auto or health claim": "claim_type", "date": "incident_datetime", "time": "incident_datetime",
    "location": "incident_location", "address": "incident_location", "injury": "injuries_or_symptoms", "symptom": "injuries_or_symptoms",
    "pain": "injuries_or_symptoms", "what happened": "how_it_happened", "incident description": "how_it_happened",
    "medical treatment": "treatment_received", "doctor": "provider_name", "hospital": "provider_name", "clinic": "provider_name",
    "vehicle drivable": "vehicle_drivable", "car drivable": "vehicle_drivable", "license plate": "other_party_plate",
    "other party insurer": "other_party_insurer", "fault": "fault_admission", "witness": "witnesses", "repair shop": "settlement_preference",
    "reimbursement preference": "settlement_preference", "police": "police_or_ambulance", "ambulance": "police_or_ambulance",
    "police case number": "police_case_number",
}
LABEL_ALIASES = {
    "accident_date": "incident_datetime", "accident_time": "incident_datetime", "accident_location": "incident_location",
    "injury_description": "injuries_or_symptoms", "damage_description": "how_it_happened", "incident_description": "how_it_happened",
    "witness_name": "witnesses", "police_involved": "police_or_ambulance", "police_case_number": "police_case_number",
    "medical_treatment": "treatment_received", "provider": "provider_name",
}

# Keywords that trigger lookups and modes; places in the order in which they are tried.
WEATHER_WORDS = ["a4", "a5", "a9", "a10", "autobahn", "berlin", "münchen", "munich", "stuttgart", "köln", "cologne", "hauptstraße"]
TOWING_WORDS = ["drivable", "kann nicht fahren", "totaled"]
COVERAGE_WORDS = ["covered", "cover", "deckt", "gedeckt", "versichert", "zahlt", "übernimmt", "übernommen", "selbstbeteiligung", "vollkasko", "teilkasko", "kasko", "parkschaden", "parkschäden", "diebstahl", "entwendung", "vandalismus"]
DISTRESS_WORDS = ["crying", "shaking", "scared", "panik", "weine", "i can't", "i don't know what to do"]
NOISE_WORDS = ["highway noise", "traffic", "loud", "static", "[noise]"]
PLACES = ["a1", "a2", "a3", "a4", "a5", "a6", "a7", "a8", "a9", "a10", "autobahn", "köln", "koln", "cologne", "berlin", "münchen", "munich", "stuttgart", "hamburg", "frankfurt", "düsseldorf", "hauptstraße", "hauptstrasse", "street", "road", "hospital", "clinic", "krankenhaus", "klinik", "medical center"]

# Open targets that are named, turns before the wrap-up, sizes of histories and windows.
OPEN_NAMED, WRAP_UP_TURN, HISTORY, REPLAY, TOOL_FEED, LAST_TOOLS = 4, 6, 500, 200, 10, 3
CHUNK_WORDS, SILENCE_SECONDS, DETAIL_PILLARS = 20, 3.0, 7
TOOL_SUMMARY_CHARS, REPLY_CHARS = 300, 280

# Drift, gate and migration thresholds.
PSI_BINS, PSI_EPS, PSI_DRIFT = 10, 1e-6, 0.2
GROUNDED_FLOOR, GROUNDED_DROP, DRIFT_WINDOW = 0.9, 0.05, 200
TOLERANCES = {"precision": 0.02, "ndcg": 0.02, "groundedness": 0.05, "extraction_f1": 0.02}
PROVENANCE_KEYS = ["judge_backend", "judge_model", "embed_backend", "rerank_backend", "active_version", "eval_k", "golden_set_sha256"]
SHADOW_TOLERANCE = 0.01
MODEL_FAMILIES = {"gemma": "google", "llama": "meta", "qwen": "qwen", "mistral": "mistral", "mixtral": "mistral"}
BACKEND_FAMILIES = {"gemini": "google", "ollama": "local-oss"}

# Embedding versions and the namespace of point ids.
EMBEDDING_VERSIONS = {"emb_v1": ("BAAI/bge-m3", 1024), "emb_v2": ("BAAI/bge-base-en-v1.5", 768)}
POINT_NAMESPACE = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
