"""The bundled lexicon: words that place a writer in an Australian workplace, written for this library.

Public bodies, Acts and modern awards are public facts; what people call forms, systems and safety
papers at work is our own choice.  A lexicon of an employer's own words is a parameter, and better.
A term is named once; its plural and the forms after "the" and "our" follow by rule.
"""

from __future__ import annotations

# Bodies and the short names that they use.
BODIES = (
    ("Safe Work Australia", "SWA"), ("Fair Work Ombudsman", "FWO"), ("Fair Work Commission", "FWC"), ("Comcare", ""), ("Australian Human Rights Commission", "AHRC"), ("Australian Public Service Commission", "APSC"),
    ("Merit Protection Commissioner", ""), ("Office of the Australian Information Commissioner", "OAIC"), ("Civil Aviation Safety Authority", "CASA"), ("Australian Maritime Safety Authority", "AMSA"), ("Office of the National Rail Safety Regulator", "ONRSR"),
    ("National Heavy Vehicle Regulator", "NHVR"), ("NOPSEMA", ""), ("ARPANSA", ""), ("NDIS Quality and Safeguards Commission", "NDIS Commission"), ("Aged Care Quality and Safety Commission", "ACQSC"), ("Asbestos and Silica Safety and Eradication Agency", "ASSEA"),
    ("Federal Safety Commissioner", "OFSC"), ("SafeWork NSW", ""), ("WorkSafe Victoria", ""), ("Workplace Health and Safety Queensland", "WHSQ"), ("WorkSafe WA", ""), ("SafeWork SA", ""), ("WorkSafe Tasmania", ""), ("NT WorkSafe", ""), ("WorkSafe ACT", ""),
    ("State Insurance Regulatory Authority", "SIRA"), ("icare", ""), ("ReturnToWorkSA", ""), ("WorkCover Queensland", ""),
)
# Acts, and what they are called for short.
LAWS = (
    ("Work Health and Safety Act 2011", "WHS Act"), ("Work Health and Safety Regulations 2011", "WHS Regulations"), ("Fair Work Act 2009", "Fair Work Act"), ("Privacy Act 1988", "Privacy Act"), ("Public Service Act 1999", "Public Service Act"),
    ("Public Interest Disclosure Act 2013", "PID Act"), ("Safety Rehabilitation and Compensation Act 1988", "SRC Act"), ("Disability Discrimination Act 1992", "Disability Discrimination Act"), ("Sex Discrimination Act 1984", "Sex Discrimination Act"),
    ("Racial Discrimination Act 1975", "Racial Discrimination Act"), ("Age Discrimination Act 2004", "Age Discrimination Act"), ("Occupational Health and Safety Act 2004", "OHS Act"), ("Long Service Leave Act", "LSL Act"), ("National Employment Standards", "NES"),
)
# label: (term, other words for it)
INTERNAL = {
    "time and pay": (
        ("timesheet", ("time sheet", "flex sheet")), ("payroll portal", ("payroll system", "pay portal")), ("rostering system", ("rostering app", "roster portal")), ("shift swap form", ("shift swap request",)), ("leave application form", ("leave request form",)),
        ("salary packaging form", ()), ("higher duties form", ("higher duties allowance",)), ("overtime claim form", ("overtime sheet",)),
    ),
    "personnel file": (
        ("position description", ()), ("position number", ("employee number", "staff number", "payroll number")), ("probation report", ("probation review",)), ("exit interview", ()), ("onboarding pack", ("induction pack",)), ("delegations register", ("delegation schedule",)),
        ("performance review", ("annual performance review", "mid year review", "mid cycle review")), ("performance improvement plan", ("pip",)), ("performance development agreement", ("performance agreement",)), ("workplace adjustment passport", ("reasonable adjustment plan",)),
    ),
    "internal system": (
        ("staff intranet", ("intranet",)), ("staff portal", ("employee portal",)), ("HR system", ("hris", "hr information system")), ("learning management system", ("lms",)), ("service desk ticket", ("helpdesk ticket", "it ticket")), ("document management system", ("records system",)),
        ("case management system", ("client management system",)), ("incident reporting system", ("incident portal", "hazard reporting app")),
    ),
    "internal policy": (
        ("code of conduct", ()), ("grievance procedure", ("grievance policy",)), ("flexible working policy", ("working from home policy", "hybrid work policy")), ("social media policy", ()), ("conflict of interest declaration", ()), ("employee assistance program", ("eap",)),
        ("fitness for duty assessment", ("fitness for work assessment",)), ("drug and alcohol policy", ("drug and alcohol test",)),
    ),
    "safety role": (("health and safety representative", ("hsr", "safety rep")), ("emergency warden", ("fire warden", "floor warden")), ("first aid officer", ()), ("rehabilitation case manager", ("rehab case manager",)), ("return to work coordinator", ("rtw coordinator",)), ("person conducting a business or undertaking", ("pcbu",))),
    "safety paper": (
        ("safe work method statement", ("swms",)), ("job hazard analysis", ("jha", "job hazard analyses")), ("safe operating procedure", ()), ("safety data sheet", ("sds",)), ("permit to work", ("hot work permit", "confined space permit")), ("near miss report", ("near miss form",)),
        ("plant risk assessment", ()), ("hazard report form", ("hazard card",)), ("site induction card", ("white card",)), ("provisional improvement notice", ()), ("safety management plan", ("safety plan",)), ("risk register", ()),
    ),
    "safety practice": (("toolbox talk", ("prestart meeting", "prestart briefing")), ("lockout tagout", ("isolation procedure",)), ("designated work group", ("dwg",)), ("health and safety committee", ("safety committee",)), ("critical incident debrief", ("critical incident",)), ("psychosocial hazard", ("psychosocial risk",)), ("wellbeing check", ("welfare check",))),
    "injury and claim": (("workers compensation claim", ("workers comp claim", "compensation claim")), ("workers compensation", ("workers comp",)), ("return to work plan", ("return to work", "rtw plan")), ("injury register", ("register of injuries",)), ("certificate of capacity", ()), ("independent medical examination", ("independent medical exam",)), ("provisional liability", ())),
    "care and transport": (("ndis participant", ("ndis plan", "ndis")), ("behaviour support plan", ()), ("medication chart", ("medication round",)), ("resident care plan", ()), ("fatigue management plan", ("work diary",)), ("chain of responsibility", ())),
}
AGREEMENTS = (("enterprise agreement", ("eba", "enterprise bargaining agreement", "workplace agreement")), ("modern award", ()), ("individual flexibility arrangement", ()))
# Modern awards by their public codes.
AWARDS = (
    ("MA000002", "clerks private sector"), ("MA000003", "fast food industry"), ("MA000004", "general retail industry"), ("MA000009", "hospitality industry"), ("MA000010", "manufacturing"), ("MA000016", "security services industry"), ("MA000018", "aged care"),
    ("MA000020", "building and construction"), ("MA000022", "cleaning services"), ("MA000034", "nurses"), ("MA000038", "road transport and distribution"), ("MA000084", "storage services"), ("MA000100", "SCHADS"), ("MA000120", "children's services"),
)
#: Terms that must stand as they are: one letter off is another phrase.
EXACT = (("duty of care", "safety practice"),)


def _plural(term: str) -> str:
    return term if term.endswith("s") else term[:-1] + "ies" if term.endswith("y") and term[-2] not in "aeiou" else term + "s"


def _with_articles(forms: list[str]) -> list[str]:
    return [*forms, *(f"{a} {f}" for f in forms for a in ("the", "our"))]


def entries() -> list[dict]:
    """``term, category, label, aliases, exact_only`` of every term, in order."""
    out: list[dict] = []

    def add(term, category, label, aliases, exact=False):
        own = dict.fromkeys(a for a in aliases if a and a.lower() != term.lower())
        out.append({"term": term, "category": category, "label": label, "aliases": list(own), "exact_only": exact})

    def add_common(term, category, label, others):
        forms = [term, *others]
        add(term, category, label, [*_with_articles(forms), *(_plural(f) for f in forms)])

    for term, others in AGREEMENTS:
        add_common(term, "award", term, others)
    for code, trade in AWARDS:
        add(code, "award", f"{trade} award", [f"{trade} award", f"{trade.replace(chr(39), '')} award"])
    for name, short in BODIES:
        add(name, "internal_term", "public body", _with_articles([name, *([short] if short else [])]))
    for name, short in LAWS:
        add(name, "internal_term", "law", _with_articles([name, short, *([f"{short} {name[-4:]}"] if name[-4:].isdigit() else [])]))
    for label, terms in INTERNAL.items():
        for term, others in terms:
            add_common(term, "internal_term", label, others)
    for term, label in EXACT:
        add(term, "internal_term", label, (), exact=True)
    return out
