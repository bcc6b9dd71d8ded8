"""Word lists and patterns that must be equal for equal labels."""

STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or",
              "that", "the", "to", "with"]

VALID_IMPACT_TYPES = [
    "automation_exposure", "automation_risk", "augmentation_potential", "task_displacement", "task_transformation",
    "skill_change", "employment_effect", "wage_effect", "productivity_effect", "job_creation", "job_loss",
    "inequality_or_polarization", "worker_vulnerability", "worker_advantage", "education_or_training_need",
    "human_advantage", "ethical_concern", "bias_concern", "surveillance_concern", "safety_concern",
    "uncertainty_or_limitation", "labor_market_context", "other",
]
STRONG_IMPACT_TYPES = [
    "worker_vulnerability", "worker_advantage", "job_loss", "job_creation", "inequality_or_polarization",
    "ethical_concern", "bias_concern", "surveillance_concern", "safety_concern", "uncertainty_or_limitation",
    "education_or_training_need", "skill_change", "wage_effect", "productivity_effect",
]
VALID_DIRECTIONS = ["positive", "negative", "mixed", "uncertain"]

# Lists are looked up by role; a caller may pass the same roles with other words.
IMPACT_TERMS = {
    "legacy_exposure_labels": ["llm_exposure"],
    "bias": ["bias", "discrimination"],
    "surveillance": ["surveillance", "monitoring"],
    "safety": ["safety", "unsafe", "risk to safety"],
    "ethics": ["ethic", "privacy", "fairness", "accountability"],
    "transition": ["occupational transition", "occupational transitions", "occupational shift", "occupational shifts",
                   "workers transition", "worker transition", "declining occupations", "redeployment", "displacement"],
    "occupational_transition": ["occupational transition", "occupational transitions"],
    "declining": ["declining occupations"],
    "rising": ["rising", "rising ones"],
    "stranded": ["unable", "vulnerability", "vulnerable", "left behind"],
    "worker": ["worker", "workers"],
    "slow": ["slow", "slower"],
    "exposure_patterns": [
        "could[ ]+be[ ]+automated", "may[ ]+be[ ]+automated", "might[ ]+be[ ]+automated",
        "hours[ ]+worked[ ]+could[ ]+be[ ]+automated", "hours[ ]+automated", "tasks?[ ]+(?:could[ ]+be[ ]+)?automated",
        "automation[ ]+potential", "automatable", "exposure[ ]+to[ ]+automation", "exposure[ ]+to[ ]+ai", "ai[ ]+exposure",
    ],
    "automation": ["automation", "automated", "automate", "automatable", "ai exposure", "exposure to ai",
                   "exposure to automation"],
    "risk": ["risk", "displacement", "displaced", "decline", "declining", "loss", "losses", "replacement", "replace",
             "job loss", "employment decline", "harm", "vulnerability", "vulnerable"],
    "training": ["training", "retraining", "reskilling", "education", "upskilling", "skills upgrade"],
    "inequality": ["inequality", "polarization", "polarisation", "polarized", "polarised", "unequal"],
    "vulnerability": ["vulnerability", "vulnerable", "challenge", "barrier", "risk", "unable", "left behind"],
    "loss_patterns": [
        "jobs?[ ]+(?:loss|losses|lost|decline|declines|declined|fall|falling)",
        "employment[ ]+(?:decline|declines|declined|fall|falling|loss|losses)",
        "demand[ ]+for[ ]+(?:workers|occupations|jobs|professions)[^\n]*[^a-z0-9_]decline",
        "occupations?[^\n]*[^a-z0-9_]decline", "workers?[^\n]*[^a-z0-9_]displaced",
    ],
    "creation_patterns": [
        "new[ ]+job[ ]+roles?", "new[ ]+jobs?", "jobs?[ ]+(?:created|creation|added|gained)", "create[ ]+(?:new[ ]+)?jobs?",
        "demand[ ]+for[ ]+(?:workers|occupations|jobs|professions)[^\n]*[^a-z0-9_](?:rise|rises|rising|increase|increases|grow|growth)",
    ],
    "wage": ["wage", "wages", "earnings", "pay", "salary"],
    "skill": ["skill", "skills"],
    "task_loss": ["displace", "substitute", "replace"],
    "task_change": ["transform", "change", "redesign", "reweight"],
    "productivity": ["productivity", "output", "efficiency", "efficient"],
    "job_roles": ["new[ ]+job[ ]+roles?", "job[ ]+roles?", "new[ ]+jobs?", "jobs?[ ]+(?:created|creation|added)",
                  "creation[ ]+of[ ]+new[ ]+jobs?"],
}
DIRECTION_TERMS = {
    "negative": ["limit", "limited", "slow", "slower", "decline", "declining", "decrease", "decreases", "fall", "falling",
                 "loss", "losses", "job loss", "displacement", "displaced", "dislocation", "unable", "vulnerability",
                 "vulnerable", "risk", "harm", "barrier", "hinder", "shortage", "concern", "fears", "threat", "lower",
                 "reduced", "negative", "replacement", "replace"],
    "positive": ["gain", "gains", "increase", "increases", "increasing", "rise", "rises", "rising", "growth", "grow",
                 "improve", "improvement", "create", "creates", "creation", "opportunity", "opportunities", "advantage",
                 "benefit", "benefits", "boost", "add", "higher demand", "successful", "effectively"],
    "uncertain": ["could", "may", "might", "potential", "scenario", "exposure", "transition", "transitions", "estimate",
                  "uncertain", "suggesting"],
    "transition_harm": ["slow", "slower", "unable", "displacement", "displaced"],
    "limiting": ["limit", "limited", "slow", "slower", "hinder", "reduced"],
}
RELEVANCE_PATTERNS = {
    "direct_ai": ["artificial intelligence", "generative ai", "large language model", "chatgpt", "machine learning",
                  "algorithmic"],
    "direct_ai_words": ["ai", "gen ai", "llm", "llms"],
    "automation_or_technology": ["automation", "automated", "automate", "technology adoption", "technological change",
                                 "digitalization", "digitalisation", "robotics", "software", "computerization",
                                 "computerisation"],
    "indirect_labor_context": ["occupation", "occupational", "worker", "workers", "employment", "wage", "skill", "skills",
                               "training", "productivity", "transition", "redeployment", "displacement"],
    "indirect_labor_context_words": ["job", "jobs", "labor", "labour"],
}
GENERIC_ENTITIES = ["occupation", "occupations", "job", "jobs", "workers", "worker", "workforce", "labor market",
                    "labour market", "general labor market", "businesses"]

PREFERENCE_KEYWORDS = {
    "ai-aware career planning": ["ai", "automation", "automated", "artificial intelligence", "future proof"],
    "technology systems": ["technology", "tech", "software", "computer", "systems", "digital", "programming"],
    "data and numbers": ["data", "numbers", "analytics", "analysis", "statistical", "statistics", "math"],
    "research and problem solving": ["research", "science", "investigate", "understand", "problem", "solve"],
    "hands-on technical work": ["hands-on", "tools", "machines", "equipment", "build", "repair", "fix"],
    "outdoor or field work": ["outdoor", "outside", "field", "nature", "environment"],
    "creative design or writing": ["creative", "design", "visual", "writing", "art", "music", "perform"],
    "teaching or guiding people": ["teach", "teaching", "guide", "guiding", "help", "support", "mentor"],
    "leading or persuading": ["lead", "leading", "persuade", "sell", "sales", "pitch", "manage"],
    "structured independent work": ["structured", "organized", "records", "process", "independent", "alone"],
    "fast-paced projects": ["fast", "pace", "short projects", "multiple projects", "startup"],
    "job stability concern": ["stability", "stable", "secure", "risk", "worry", "concern", "realistic"],
    "lower social intensity": ["less people", "low social", "alone", "independent", "not talking"],
}
PREFERENCE_GROUPS = [
    ("Tasks and tools", ["technology", "data", "math", "analyt", "problem", "research", "ai"]),
    ("Work style", ["fast", "pace", "structured", "independent", "autonomy", "schedule"]),
    ("People and setting", ["social", "people", "teaching", "guiding", "listening", "interaction"]),
    ("Career direction", ["own", "leading", "career", "consult", "security", "impact"]),
]

METRIC_IMPACT_RULES = [
    ("automation", ["automation", "automate", "directive"]),
    ("augmentation", ["augmentation", "augment", "collaboration", "feedback", "iterative", "iteration", "learning",
                      "validation"]),
    ("task_penetration", ["penetration"]),
    ("job_exposure", ["job_exposure", "job exposure"]),
    ("exposure", ["exposure"]),
    ("observed_usage", ["usage", "count", "conversation", "aui"]),
]
METRIC_TERMS = ["automation", "automate", "directive", "augmentation", "augment", "collaboration", "feedback",
                "iteration", "iterative", "learning", "validation", "penetration", "exposure", "percent", "percentage",
                "share", "rate", "score", "value", "pct", "usage", "count", "conversation", "aui"]
METRIC_IDENTIFIERS = ["soc", "code", "id", "title", "occupation", "task", "description", "name", "date", "url", "file",
                      "text"]
METRIC_STRONG_TERMS = ["score", "value", "pct", "percent", "share", "rate", "count", "usage", "exposure", "penetration",
                       "automation", "augmentation"]
ALWAYS_METRIC_TERMS = ["automation", "augmentation", "exposure", "penetration"]

INTEREST_KEYWORDS = {
    "R": ["outdoor", "outside", "field", "physical", "hands", "tools", "machines", "equipment", "build", "fix", "repair",
          "technical"],
    "I": ["research", "analyze", "analysis", "data", "information", "science", "problem", "debug", "expert", "knowledge",
          "understand"],
    "A": ["creative", "design", "art", "write", "writing", "music", "visual", "flexible", "original", "create"],
    "S": ["people", "help", "support", "teach", "coach", "empathy", "gratitude", "community", "client", "human"],
    "E": ["lead", "leader", "sell", "persuade", "business", "startup", "run", "scale", "manage", "visible"],
    "C": ["structure", "schedule", "organized", "process", "rules", "office", "stable", "security", "records", "clear"],
}
QUERY_TYPE_RULES = [
    ("technology_career", ["machine learning", "artificial intelligence", "data science", "deep learning",
                           "predictive modeling", "predictive modelling"]),
    ("day_in_life", ["day in the life", "daily", "routine", "what does", "typical day"]),
    ("education", ["education", "degree", "training", "qualification", "job zone"]),
    ("interests", ["interests", "personality", "fit", "riasec"]),
    ("tasks", ["tasks", "responsibilities", "duties"]),
]
SKILL_QUERY_TERMS = ["skills", "learn", "abilities", "knowledge", "requirements"]
SOFTWARE_QUERY_TERMS = ["software used", "software skills", "software tools", "tools", "technologies", "python", "excel",
                        "sql"]
SOFTWARE_JOB_PHRASES = ["software developer", "software developers", "software engineer", "software engineers"]
SUPPLEMENTAL_RULES = [
    ("alternatives", "related_occupations", ["alternative careers", "similar careers", "related careers", "related jobs",
                                             "career alternatives", "jobs like", "similar jobs"]),
    ("task_dwa", "task_dwa_mapping", ["dwa", "detailed work activities", "task mapping", "task-dwa", "task dwa",
                                      "connected to tasks", "connected to data scientist tasks",
                                      "work activities connected to tasks"]),
    ("content_model_linkage", "content_model_linkage", ["linked to skill", "linked to mathematics",
                                                        "work activities are linked to",
                                                        "skills linked to work context",
                                                        "abilities linked to work activities",
                                                        "work styles linked to work context",
                                                        "linked to work activities", "linked to work context"]),
    ("aliases", "occupation_aliases", ["bi analyst", "cfo", "ceo", "cto", "cio", "ciso", "actuarial clerk",
                                       "business analyst", "business intelligence analyst", "software engineer",
                                       "systems analyst", "data analyst"]),
]
INFORMATION_TERMS = ["analyze", "analysis", "assess", "calculate", "compare", "data", "database", "design", "document",
                     "draft", "estimate", "evaluate", "forecast", "mathematical", "model", "monitor", "numerical", "plan",
                     "problem", "prepare", "program", "report", "research", "review", "software", "statistical", "study",
                     "summarize", "technique", "theories", "write"]
COMPLIANCE_TERMS = ["compliance", "permit", "policy", "regulation", "regulatory", "risk", "standards"]
PHYSICAL_TERMS = ["backfill", "clean", "compact", "construction", "equipment", "hazard", "inspect", "inspection",
                  "install", "maintain", "operate", "picks", "repair", "shovels", "sample", "site", "supervise", "test",
                  "traffic", "trenches"]
GERUNDS = {
    "analyze": "analyzing", "analyse": "analyzing", "assess": "assessing", "build": "building",
    "calculate": "calculating", "collect": "collecting", "communicate": "communicating", "compile": "compiling",
    "conduct": "conducting", "coordinate": "coordinating", "create": "creating", "design": "designing",
    "develop": "developing", "evaluate": "evaluating", "examine": "examining", "identify": "identifying",
    "inspect": "inspecting", "interpret": "interpreting", "maintain": "maintaining", "manage": "managing",
    "monitor": "monitoring", "operate": "operating", "organize": "organizing", "perform": "performing",
    "prepare": "preparing", "provide": "providing", "review": "reviewing", "test": "testing", "write": "writing",
}
