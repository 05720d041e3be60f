"""Standard phrases of drafts in English and Hindi."""

# Languages and their own names.
LANGUAGES = {
    "en": ("English", "English"),
    "hi": ("Hindi", "हिंदी"),
    "mr": ("Marathi", "मराठी"),
    "ta": ("Tamil", "தமிழ்"),
    "te": ("Telugu", "తెలుగు"),
}
DEFAULT_LANGUAGE = "en"

# Fixed values: (key, English, Hindi); {{ name }} stands for a fact of the draft.
PHRASES = [
    ("dear_sir_madam", "Sir/Madam,", "महोदय/सुश्री,"),
    ("to", "To,", "से,"),
    ("yours_faithfully", "Yours faithfully,", "आपका वफादार,"),
    ("yours_sincerely", "Yours sincerely,", "आपका सन्मानपूर्वक,"),
    ("copy_to_client", "Copy to: My client, for record.", "प्रति: मेरे मुवक्किल के लिए रिकॉर्ड।"),
    ("ref", "Ref:", "संदर्भ:"),
    ("date_label", "Date:", "दिनांक:"),
    ("sub", "Sub:", "विषय:"),
    ("registered_post_ad", "BY REGISTERED POST A.D.", "पंजीकृत डाक द्वारा"),
    ("and_by_email", "AND BY EMAIL", "और ईमेल द्वारा"),
    ("enclosures", "Enclosures:", "संलग्नक:"),
    ("copy_to_opposite_party", "Copy to: Opposite Party / Respondent, for information.", "प्रति: प्रतिपक्षी पक्ष / उत्तरदाता, जानकारी के लिए।"),
    ("under_instructions", "Under instructions from and on behalf of my client", "मेरे मुवक्किल की आदेशों के अनुसार और उनकी ओर से"),
    ("hereinafter_client", '(hereinafter "my client")', '(इसके बाद "मेरा मुवक्किल")'),
    ("that_you_are_acquainted", "That you are well acquainted with my client and the transactions between you and my client.", "यह कि आप मेरे मुवक्किल से और आपके बीच के लेन-देन से अच्छी तरह से परिचित हैं।"),
    ("that_legally_liable_to_pay", "That you were and continue to be legally liable to pay a sum of Rs {{ amount_inr }}/- (Rupees {{ amount_words }} only) to my client.", "यह कि आप मेरे मुवक्किल को रु. {{ amount_inr }}/- (शब्दों में {{ amount_words }} मात्र) भुगतान करने के लिए कानूनी रूप से उत्तरदायी थे और अभी भी हैं।"),
    ("cheque_issued", 'That in discharge of the said legally enforceable debt and liability, you issued to my client cheque bearing No. {{ cheque_number }} dated {{ cheque_date }} for a sum of Rs {{ cheque_amount_inr }}/- drawn on {{ drawee_bank }}, {{ drawee_branch }} branch{{ drawer_account_clause }} (hereinafter "the said cheque").', "यह कि उक्त कानूनी रूप से प्रवर्तनीय ऋण और दायित्व की अदायगी में आपने मेरे मुवक्किल को रु. {{ cheque_amount_inr }}/- का धनादेश जारी किया जिसका संख्या {{ cheque_number }} तिथि {{ cheque_date }} है, जो {{ drawee_bank }}, {{ drawee_branch }} शाखा पर आयोजित है{{ drawer_account_clause }}।"),
    ("presented_for_encashment", "That my client presented the said cheque for encashment through {{ payee_bank }}, {{ payee_branch }} branch, on {{ presentation_date }}.", "यह कि मेरे मुवक्किल ने उक्त धनादेश को {{ payee_bank }}, {{ payee_branch }} शाखा के द्वारा {{ presentation_date }} को नगदिकरण के लिए प्रस्तुत किया।"),
    ("returned_unpaid", 'That the said cheque was returned unpaid by the drawee bank with the endorsement "{{ dishonour_reason }}", and the said return memo dated {{ dishonour_memo_date }} was received by my client on {{ dishonour_date }}.', 'यह कि उक्त धनादेश को प्राप्तकर्ता बैंक द्वारा "{{ dishonour_reason }}" कहकर बिना भुगतान वापस कर दिया गया, और तारीख {{ dishonour_memo_date }} का वह वापसी मेमो मेरे मुवक्किल को {{ dishonour_date }} को प्राप्त हुआ।'),
    ("dishonour_is_offence", "That the dishonour of the said cheque is on account of your act and omission, and constitutes an offence punishable under Section 138 of the Negotiable Instruments Act, 1881.", "यह कि उक्त धनादेश की अवज्ञा आपके कार्य और अकरण के कारण हुई है, और वह धनादेश अधिनियम, 1881 की धारा 138 के तहत दंडनीय अपराध है।"),
    ("therefore_call_upon", "I therefore call upon you, through this notice, to pay to my client the sum of Rs {{ amount_inr }}/- (Rupees {{ amount_words }} only)", "अतः मैं आपको इस नोटिस के द्वारा कहता हूं कि मेरे मुवक्किल को रु. {{ amount_inr }}/- (शब्दों में {{ amount_words }} मात्र) भुगतान करें"),
    ("fifteen_days", "FIFTEEN (15) DAYS", "पंद्रह (15) दिन"),
    ("within_days_failing", "from the date of receipt of this notice, failing which my client shall be constrained to initiate criminal proceedings against you under Section 138 of the Negotiable Instruments Act, 1881 before the competent court, entirely at your risk as to costs and consequences.", "इस नोटिस की प्राप्ति की तारीख से, अन्यथा मेरा मुवक्किल आपके खिलाफ आपराधिक कार्यवाही शुरू करने के लिए विवश हो जाएगा।"),
    ("in_the_high_court", "IN THE HIGH COURT OF JUDICATURE AT {{ court_place }}", "{{ court_place }} में उच्च न्यायालय में"),
    ("in_the_supreme_court", "IN THE SUPREME COURT OF INDIA", "भारत के उच्चतम न्यायालय में"),
    ("appellate_jurisdiction", "{{ jurisdiction_type }} APPELLATE JURISDICTION", "{{ jurisdiction_type }} अपील न्यायाधिकरण"),
    ("appellate_original_jurisdiction", "{{ jurisdiction_type }} JURISDICTION", "{{ jurisdiction_type }} न्यायाधिकरण"),
    ("original_jurisdiction", "ORIGINAL JURISDICTION", "मूल न्यायाधिकरण"),
    ("writ_petition_no", "WRIT PETITION NO. {{ petition_number }} OF {{ year }}", "रिट याचिका संख्या {{ petition_number }} वर्ष {{ year }}"),
    ("civil_appeal_no", "CIVIL APPEAL NO. {{ appeal_number }} OF {{ year }}", "नागरिक अपील संख्या {{ appeal_number }} वर्ष {{ year }}"),
    ("criminal_appeal_no", "CRIMINAL APPEAL NO. {{ appeal_number }} OF {{ year }}", "आपराधिक अपील संख्या {{ appeal_number }} वर्ष {{ year }}"),
    ("between", "BETWEEN", "बीच"),
    ("and", "AND", "और"),
    ("petitioner_label", "... Petitioner(s) / Appellant(s)", "... याचिकाकर्ता / अपीलकर्ता"),
    ("respondent_label", "... Respondent / Opposite Party", "... उत्तरदाता / प्रतिपक्षी"),
    ("under_articles", "UNDER ARTICLES 226 AND 227 OF THE CONSTITUTION OF INDIA", "भारत के संविधान के अनुच्छेद 226 और 227 के तहत"),
    ("most_respectfully_showeth", "MOST RESPECTFULLY SHOWETH:", "सादर दर्शाते हैं:"),
    ("the_facts_are_as_under", "The facts of the case are as under:", "मामले के तथ्य निम्नलिखित हैं:"),
    ("grounds_for_relief", "The grounds for the relief claimed are as under:", "दावा किए गए राहत के आधार निम्नलिखित हैं:"),
    ("prayer_heading", "PRAYER", "प्रार्थना"),
    ("prays_relief", "It is, therefore, most humbly prayed that this Hon'ble Court may be pleased to:", "अतः सादर प्रार्थना है कि इस आदरणीय अदालत से कृपया:"),
    ("prayer_bullet", "{{ item }}; and", "{{ item }}; तथा"),
    ("and_pass_such_other", "And pass such other order or orders as this Hon'ble Court may deem fit and proper in the circumstances of the case.", "और मामले की परिस्थितियों में इस आदरणीय अदालत को उचित और युक्त मानने वाला अन्य कोई आदेश भी जारी करें।"),
    ("consumer_complaint_no", "CONSUMER COMPLAINT NO. ________ OF {{ filing_year }}", "उपभोक्ता शिकायत संख्या ________ वर्ष {{ filing_year }}"),
    ("complaint_under_section", "COMPLAINT UNDER SECTION {{ section }} OF THE {{ act }}", "{{ act }} की धारा {{ section }} के तहत शिकायत"),
    ("complainant_is_consumer", "That the Complainant is a consumer within the meaning of Section 2(7) of the Consumer Protection Act, 2019, having {{ consumer_basis }}.", "यह कि शिकायतकर्ता उपभोक्ता सुरक्षा अधिनियम, 2019 की धारा 2(7) के अर्थ में उपभोक्ता है, जिसकी {{ consumer_basis }} है।"),
    ("opposite_party_is", "That the Opposite Party is {{ description }} and is a {{ party_type }} within the meaning of the Act.", "यह कि प्रतिपक्षी पक्ष {{ description }} है और अधिनियम के अर्थ में {{ party_type }} है।"),
    ("deficiency_in_service", "deficiency in service within the meaning of Section 2(11) of the Consumer Protection Act, 2019", "सेवा में कमी उपभोक्ता सुरक्षा अधिनियम, 2019 की धारा 2(11) के अर्थ में"),
    ("defective_goods_unfair_trade", "sale of defective goods and unfair trade practice within the meaning of Sections 2(10) and 2(47) of the Consumer Protection Act, 2019", "दोषपूर्ण सामान की बिक्री और अन्यायपूर्ण व्यापारिक प्रथा उपभोक्ता सुरक्षा अधिनियम, 2019 की धाराओं 2(10) और 2(47) के अर्थ में"),
    ("advocate_for_complainant", "Advocate for the Complainant", "शिकायतकर्ता के वकील"),
    ("reply_to_notice_subject", "Reply to your notice dated {{ original_notice_date }}", "आपकी तारीख {{ original_notice_date }} की नोटिस का उत्तर"),
    ("reply_to_notice_intro", "I reply to your notice dated", "मैं आपकी तारीख की नोटिस का उत्तर देता हूं"),
    ("verification", "VERIFICATION", "सत्यापन"),
    ("verification_body", "I, {{ deponent_name }}, {{ deponent_capacity }}, do hereby verify that the contents of paras {{ para_range }} of the foregoing {{ doc_type }} are true and correct to my knowledge and belief and nothing material has been concealed therefrom. I further declare that this verification is made on the basis of documents maintained in the ordinary course of business which I believe to be true.", "मैं, {{ deponent_name }}, {{ deponent_capacity }} यहां सत्यापित करता/करती हूं कि पूर्वोक्त {{ doc_type }} के {{ para_range }} पैराग्राफ की सामग्री मेरी जानकारी और विश्वास के अनुसार सत्य और सही है और उसमें से कोई भी सारी बात छुपाई नहीं गई है। मैं यह और घोषणा करता/करती हूं कि यह सत्यापन व्यवसाय के साधारण क्रम में रखे गए दस्तावेजों के आधार पर किया गया है जो मेरी विश्वास के अनुसार सत्य हैं।"),
    ("solemnly_affirm", "Solemnly affirmed at {{ place }} on this {{ day }} day of {{ month }}, {{ year }}.", "साक्षात् इस {{ day }} दिन {{ month }}, {{ year }} को {{ place }} में सत्यापित किया गया।"),
    ("deponent_signature", "Signature of the Deponent", "शपथग्राही के हस्ताक्षर"),
    ("advocate_for_petitioner", "Advocate for the Petitioner", "याचिकाकर्ता के वकील"),
    ("advocate_for_respondent", "Advocate for the Respondent", "उत्तरदाता के वकील"),
    ("application_title", "APPLICATION UNDER SECTION {{ section }} OF {{ act_name }}", "{{ act_name }} की धारा {{ section }} के तहत आवेदन"),
    ("prays_for_order", "Prays for the following orders:", "निम्नलिखित आदेशों की प्रार्थना करता है:"),
    ("interim_relief", "INTERIM RELIEF", "अंतरिम राहत"),
    ("final_relief", "RELIEFS PRAYED", "दावा की राहतें"),
    ("jurisdiction_clause", "Jurisdiction:", "क्षेत्राधिकार:"),
    ("cause_of_action_arises", "The cause of action for this application arose within the jurisdiction of this Hon'ble Court on {{ date }}.", "इस आवेदन का कारण इस आदरणीय अदालत के क्षेत्राधिकार में {{ date }} को उत्पन्न हुआ।"),
]
