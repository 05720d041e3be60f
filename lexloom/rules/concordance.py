"""Old and new criminal codes: commencement, titles and matching sections."""

from datetime import date

# Fixed values.
COMMENCEMENT = date(2024, 7, 1)
CODE_TITLES = {
    "penal": ("Indian Penal Code, 1860", "Bharatiya Nyaya Sanhita, 2023"),
    "procedure": ("Code of Criminal Procedure, 1973", "Bharatiya Nagarik Suraksha Sanhita, 2023"),
    "evidence": ("Indian Evidence Act, 1872", "Bharatiya Sakshya Adhiniyam, 2023"),
}

# Fixed values: (old section, new section, subject).
PENAL = [
    ("34", "3(5)", "Acts done by several persons in furtherance of common intention"),
    ("120B", "61(2)", "Criminal conspiracy"),
    ("141", "189(1)", "Unlawful assembly"),
    ("143", "189(2)", "Punishment for unlawful assembly"),
    ("147", "191(2)", "Rioting"),
    ("153A", "196", "Promoting enmity between groups"),
    ("279", "281", "Rash driving on a public way"),
    ("299", "100", "Culpable homicide"),
    ("300", "101", "Murder"),
    ("302", "103", "Punishment for murder"),
    ("304", "105", "Punishment for culpable homicide not amounting to murder"),
    ("304A", "106", "Causing death by negligence"),
    ("304B", "80", "Dowry death"),
    ("306", "108", "Abetment of suicide"),
    ("307", "109", "Attempt to murder"),
    ("319", "114", "Hurt"),
    ("320", "116", "Grievous hurt"),
    ("323", "115(2)", "Punishment for voluntarily causing hurt"),
    ("324", "118(1)", "Voluntarily causing hurt by dangerous weapons"),
    ("325", "117(2)", "Punishment for voluntarily causing grievous hurt"),
    ("326A", "124(1)", "Voluntarily causing grievous hurt by acid attack"),
    ("354", "74", "Assault on a woman with intent to outrage her modesty"),
    ("354A", "75", "Sexual harassment"),
    ("354D", "78", "Stalking"),
    ("363", "137(2)", "Kidnapping"),
    ("375", "63", "Rape"),
    ("376", "64", "Punishment for rape"),
    ("378", "303(1)", "Theft"),
    ("379", "303(2)", "Punishment for theft"),
    ("383", "308(1)", "Extortion"),
    ("384", "308(2)", "Punishment for extortion"),
    ("390", "309(1)", "Robbery"),
    ("391", "310(1)", "Dacoity"),
    ("403", "314", "Dishonest misappropriation of property"),
    ("405", "316(1)", "Criminal breach of trust"),
    ("406", "316(2)", "Punishment for criminal breach of trust"),
    ("409", "316(5)", "Criminal breach of trust by public servant or banker"),
    ("415", "318(1)", "Cheating"),
    ("417", "318(2)", "Punishment for cheating"),
    ("420", "318(4)", "Cheating and dishonestly inducing delivery of property"),
    ("425", "324(1)", "Mischief"),
    ("441", "329(1)", "Criminal trespass"),
    ("447", "329(3)", "Punishment for criminal trespass"),
    ("448", "329(4)", "Punishment for house-trespass"),
    ("463", "336(1)", "Forgery"),
    ("465", "336(2)", "Punishment for forgery"),
    ("468", "336(3)", "Forgery for purpose of cheating"),
    ("471", "340(2)", "Using as genuine a forged document"),
    ("498A", "85", "Cruelty to a married woman by husband or his relatives"),
    ("499", "356(1)", "Defamation"),
    ("500", "356(2)", "Punishment for defamation"),
    ("503", "351(1)", "Criminal intimidation"),
    ("506", "351(2)", "Punishment for criminal intimidation"),
    ("509", "79", "Word or gesture intended to insult the modesty of a woman"),
]
PROCEDURE = [
    ("41", "35", "When police may arrest without warrant"),
    ("41A", "35(3)", "Notice of appearance before police officer"),
    ("50", "47", "Person arrested to be informed of grounds of arrest"),
    ("91", "94", "Summons to produce document or other thing"),
    ("125", "144", "Order for maintenance of wives, children and parents"),
    ("144", "163", "Power to issue order in urgent cases of nuisance or apprehended danger"),
    ("154", "173", "Information in cognizable cases (FIR)"),
    ("156", "175", "Police officer's power to investigate cognizable case"),
    ("161", "180", "Examination of witnesses by police"),
    ("164", "183", "Recording of confessions and statements"),
    ("167", "187", "Procedure when investigation cannot be completed in 24 hours"),
    ("173", "193", "Report of police officer on completion of investigation"),
    ("190", "210", "Cognizance of offences by Magistrates"),
    ("197", "218", "Prosecution of Judges and public servants - sanction"),
    ("200", "223", "Examination of complainant"),
    ("227", "262", "Discharge"),
    ("228", "263", "Framing of charge"),
    ("239", "268", "When accused shall be discharged (warrant cases)"),
    ("313", "351", "Power to examine the accused"),
    ("319", "358", "Power to proceed against other persons appearing to be guilty"),
    ("320", "359", "Compounding of offences"),
    ("354", "392", "Language and contents of judgment"),
    ("374", "415", "Appeals from convictions"),
    ("397", "438", "Calling for records to exercise powers of revision"),
    ("436", "478", "In what cases bail to be taken"),
    ("436A", "479", "Maximum period of detention of undertrial prisoner"),
    ("437", "480", "When bail may be taken in case of non-bailable offence"),
    ("438", "482", "Direction for grant of bail to person apprehending arrest"),
    ("439", "483", "Special powers of High Court or Court of Session regarding bail"),
    ("451", "497", "Order for custody and disposal of property pending trial"),
    ("482", "528", "Saving of inherent powers of High Court"),
]
EVIDENCE = [
    ("3", "2", "Interpretation clause"),
    ("5", "3", "Evidence may be given of facts in issue and relevant facts"),
    ("8", "6", "Motive, preparation and previous or subsequent conduct"),
    ("17", "24", "Admission defined"),
    ("24", "22", "Confession caused by inducement, threat or promise"),
    ("25", "23(1)", "Confession to police officer not to be proved"),
    ("27", "23(2)", "How much of information received from accused may be proved"),
    ("32", "26", "Statements by persons who cannot be called as witnesses"),
    ("45", "39", "Opinion of experts"),
    ("62", "57", "Primary evidence"),
    ("63", "58", "Secondary evidence"),
    ("65A", "63", "Special provisions as to evidence relating to electronic record"),
    ("65B", "63", "Admissibility of electronic records"),
    ("101", "104", "Burden of proof"),
    ("106", "109", "Burden of proving fact especially within knowledge"),
    ("113A", "119", "Presumption as to abetment of suicide by a married woman"),
    ("113B", "118", "Presumption as to dowry death"),
    ("114", "120", "Court may presume existence of certain facts"),
]

# Pairs where the new section is more than a renumbering.
SUBSTANTIVE_CHANGES = {
    ("procedure", "200"): "The accused must now be heard before cognizance is taken on a complaint.",
    ("procedure", "436A"): "Stricter for repeat offenders, easier for first-time offenders.",
    ("evidence", "65B"): "Two old sections are merged and the certificate is revised.",
}


def all_pairs():
    """Every pair as (domain, old section, new section, subject, note)."""
    for domain, pairs in (("penal", PENAL), ("procedure", PROCEDURE), ("evidence", EVIDENCE)):
        for old, new, subject in pairs:
            yield domain, old, new, subject, SUBSTANTIVE_CHANGES.get((domain, old))
