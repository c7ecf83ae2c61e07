"""Texts, word lists and patterns that prompts and parsers of the jobs depend on.

They are data, not logic: another wording gives other answers, another pattern other parses.
"""

# System messages.
SYSTEM = {
    "role": "You are a medical diagnostic assistant with expertise in identifying diseases based on symptoms. Respond with only the most likely disease name from the provided list of diseases.",
    "few_shot": "You are a medical diagnostic assistant with expertise in identifying diseases based on symptoms. Analyze the examples and then diagnose the new case by selecting a disease from the provided list.",
    "chain": """You are a medical diagnostic assistant with expertise in identifying diseases based on symptoms.
First, think through each symptom step by step and consider what diseases might cause these symptoms.
Then, examine how these symptoms interact with each other and narrow down to the most likely disease from the provided list.""",
    "list": "You are a medical diagnostic assistant identifying potential diseases from symptoms.",
    "rank": "You are a medical diagnostic assistant using Tree of Thought reasoning to narrow down disease possibilities.",
    "category": "You are a medical expert tasked with determining which body system is primarily affected based on symptoms.",
    "within_category": "You are a medical diagnostic specialist focusing on specific diseases within a body system.",
    "direct": "You are a medical diagnostic assistant.",
    "severity": """You are a medical severity classifier that helps determine how urgent a patient's condition is.
You analyze symptoms and assign a severity score from 1-10, where:
1-3: Mild (can be managed at home)
4-6: Moderate (should consult a doctor soon)
7-8: Severe (needs prompt medical attention)
9-10: Critical (requires emergency care)""",
    "treatment": """You are a medical treatment specialist focused on {category} diseases.
Use a combination of reasoning strategies to develop comprehensive treatment recommendations.""",
    "vote_direct": "You are a medical diagnostic assistant. Respond with only the disease name.",
    "vote_chain": "You are a medical diagnostician who thinks step by step.",
    "vote_few_shot": "You are a medical diagnostic assistant. Learn from examples and respond with ONLY the disease name, nothing else.",
    "confidence": "You are a medical confidence evaluator. Rate confidence from 0-100%.",
}

# Prompt formats.
PROMPT = {
    "zero_shot": """Based on the following symptoms, what disease might the patient have?

Symptoms: {symptoms}

Choose from the following list of diseases:
{classes}

Please respond with just the disease name from the list.""",
    "role": """Based on these symptoms, what disease might the patient have?

Symptoms: {symptoms}

Choose from the following list of diseases:
{classes}

Respond with only the disease name from the list.""",
    "few_shot": """Here are some examples of symptoms and their corresponding diseases:

{examples}

Now, based on these new symptoms, what disease might the patient have?

Symptoms: {symptoms}

Choose from the following list of diseases:
{classes}

Respond with only the most likely disease name from the list and nothing else.""",
    "chain": """Given these symptoms, I want you to think step by step about what disease the patient might have.

Symptoms: {symptoms}

1. First, analyze each symptom individually and note what diseases it could indicate.
2. Then, consider how these symptoms relate to each other.
3. Based on the symptom combination, narrow down the possible diseases.
4. Finally, select the most likely disease from this list:
{classes}

After your analysis, conclude with "The most likely disease is: [DISEASE NAME]" - using only a disease name from the provided list.""",
    "list": """Given these symptoms: {symptoms}

List the {how_many} most likely diseases from this list, ordered from most likely to least likely:
{classes}

Format your response as:
POTENTIAL DISEASES:
1. [Disease 1]
2. [Disease 2]
...and so on
""",
    "rank": """Given the symptoms: {symptoms}
    
I'm considering these possible diseases: {candidates}

For each disease, evaluate how well it matches the symptoms and rank them from most likely to least likely.
1. Consider what symptoms would be expected for each disease
2. Compare with the actual symptoms provided
3. Consider what symptoms might be missing
4. Rank the diseases from most likely to least likely

Format your response as:
RANKING:
1. [Disease 1]
2. [Disease 2]
3. [Disease 3]
""",
    "category": """Based on these symptoms, which body system or disease category is most likely affected?

Symptoms: {symptoms}

Categories to choose from: {categories}

Analyze each symptom carefully and think about which body system they primarily affect.
Respond with only the category name from the list.""",
    "within_category": """Based on these symptoms, what specific disease is the patient most likely suffering from?

Symptoms: {symptoms}

We've determined the symptoms likely affect the {category} system.
Choose from these diseases: {candidates}

Think step by step:
1. Consider which symptoms are most characteristic of diseases in this category
2. Match the symptom pattern to specific diseases
3. Identify the most likely disease based on the complete symptom profile

Respond with only the disease name.""",
    "severity": """Here are some examples of symptoms and their severity ratings:

{examples}

Based on these examples, classify the following symptoms:

Symptoms: {symptoms}

Think about:
1. How life-threatening these symptoms could be
2. How much they would impact daily functioning
3. Whether emergency intervention is needed
4. The typical medical urgency associated with these symptoms

Provide a severity rating on a scale of 1-10 and a brief one-sentence explanation.
Format your response as:
Severity: [NUMBER]/10
Explanation: [BRIEF REASON]""",
    "treatment": """I need a treatment plan for a patient with the following:

Symptoms: {symptoms}
Diagnosed Disease: {disease} 
Disease Category: {category}
Known Precautions: {known}

Similar disease precautions for reference:
{context}

Please use multiple reasoning strategies to develop a treatment plan:

1. First, analyze the disease mechanism and how it relates to the symptoms (Chain of Thought)
2. Then, consider multiple possible treatment approaches (Tree of Thought):
   - Medication options
   - Lifestyle modifications
   - Follow-up care
3. Finally, synthesize into a cohesive treatment plan considering:
   - Immediate actions
   - Long-term management
   - When to seek additional medical attention

Provide your response as:
DISEASE MECHANISM: [brief explanation of disease]
TREATMENT OPTIONS:
- [option 1 with rationale]
- [option 2 with rationale]
- [option 3 with rationale]
RECOMMENDED PLAN: [synthesized recommendation]
FOLLOW-UP: [when to check progress]""",
    "vote_direct": """Based on these symptoms, what disease does the patient have?

Symptoms: {symptoms}

Choose from: {classes}""",
    "vote_chain": """Analyze these symptoms step by step to determine the disease:

Symptoms: {symptoms}

1. First, consider what each symptom indicates
2. Then, think about which diseases could cause this combination
3. Finally, select the most likely disease from: {classes}

End with "The diagnosis is: [DISEASE]" """,
    "vote_few_shot": """Here are examples of symptoms and corresponding diseases:

{examples}

Given these examples, what disease does this new patient have?

Symptoms: {symptoms}

Choose from: {classes}

IMPORTANT: Respond with ONLY the disease name from the list, without any explanations or additional text.""",
    "confidence": """For each possible diagnosis below, rate your confidence (0-100%) that it's correct given these symptoms:

Symptoms: {symptoms}

Possible diagnoses:
{candidates}

For each disease, first explain your reasoning, then rate your confidence.
Format as: 
DISEASE: [name]
REASONING: [brief explanation]
CONFIDENCE: [0-100%]

Repeat for each disease.""",
}

# Phrases removed from the front of an answer, in this order.
ANSWER_PREFIXES = ["The disease is", "The patient has", "This patient has", "Disease:"]

# Patterns that find the answer in a longer text.
FINAL_PATTERN = r"The most likely disease is:?\s*([A-Za-z\s]+)"
DIAGNOSIS_PATTERN = r"(?i)diagnosis is:?\s*([A-Za-z\s]+)"
RANKING_PATTERN = r"RANKING:\s*1\.\s*([A-Za-z\s]+)"
LIST_LINE_PATTERN = r"^\d+\.\s*([A-Za-z\s]+)"
SEVERITY_PATTERN = r"Severity:\s*(\d+)/10"
CONFIDENCE_TAIL = r".*?CONFIDENCE:?\s*(\d+)%"

# Answers for "no match", a failed call, a missing table entry.
NO_ANSWER = "Could not determine"
UNKNOWN = "Unknown"
FAILED = "ERROR"
NO_PRECAUTIONS = "No specific precautions in database"
DEFAULT_CONFIDENCE = 50

# Urgency by severity score, both ends included.
URGENCY = [
    (1, 3, "Mild - can be managed at home"),
    (4, 6, "Moderate - should consult a doctor soon"),
    (7, 8, "Severe - needs prompt medical attention"),
    (9, 10, "Critical - requires emergency care"),
]
SEVERITY_LEVELS = [1, 3, 5, 7]

# Diseases per category, in order; a later category wins for a disease listed twice.
DISEASE_CATEGORIES = {
    "Infectious": [
        "Fungal infection", "Hepatitis", "Malaria", "Tuberculosis", "Typhoid", "Chicken pox",
        "Dengue", "Common Cold", "Pneumonia", "Dimorphic hemorrhoids(piles)",
    ],
    "Digestive": [
        "Peptic ulcer diseae", "GERD", "Chronic cholestasis", "Gastroenteritis", "Jaundice",
        "Hepatitis", "Hepatitis B", "Hepatitis C", "Hepatitis D", "Hepatitis E",
        "Alcoholic hepatitis", "Irritable bowel syndrome", "Impetigo",
    ],
    "Respiratory": ["Bronchial Asthma", "Pneumonia", "Tuberculosis", "Common Cold", "Pneumonia"],
    "Cardiovascular": ["Hypertension", "Heart attack", "Varicose veins", "Hypothyroidism", "Hypoglycemia"],
    "Skin": ["Acne", "Psoriasis", "Impetigo", "Fungal infection"],
    "Neurological": [
        "Migraine", "Cervical spondylosis", "Paralysis (brain hemorrhage)", "Osteoarthristis",
        "Vertigo", "(vertigo) Paroymsal  Positional Vertigo",
    ],
    "Metabolic": ["Diabetes", "Hyperthyroidism", "Hypothyroidism", "Hypoglycemia", "Osteoarthristis"],
    "Other": [],
}

# Terms whose neighbours are listed.
WATCHED_TERMS = [
    "acute kidney injury", "renal failure", "kidney damage", "creatinine", "uremia",
    "oliguria", "nephrotoxicity", "dialysis", "fluid overload", "hypertension",
]
