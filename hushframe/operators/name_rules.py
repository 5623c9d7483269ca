"""Name patterns by sensitivity, tried in this order.

Fixed values: (pattern, what it stands for). Matching ignores case and is
done on the name with underscores and hyphens read as spaces.
"""

HIGH_RULES = [
    (r"\bssn\b", "Social Security Number"),
    (r"\bsocial.*security", "Social Security Number"),
    (r"\bnational.*id", "National ID"),
    (r"\bpassport", "Passport Number"),
    (r"\bdriver.*licen[cs]e", "Driver's License"),
    (r"\blicen[cs]e.*num", "License Number"),
    (r"\b(first|last|middle|full|patient|member).*name\b", "Personal Name"),
    (r"\bname\b", "Name field"),
    (r"\bsurname\b", "Surname"),
    (r"\bgiven.*name", "Given Name"),
    (r"\bemail", "Email Address"),
    (r"\bphone", "Phone Number"),
    (r"\btelephone", "Telephone Number"),
    (r"\bmobile", "Mobile Number"),
    (r"\bcell", "Cell Number"),
    (r"\bfax", "Fax Number"),
    (r"\baddress", "Physical Address"),
    (r"\bstreet", "Street Address"),
    (r"\bcity\b", "City"),
    (r"\bzip", "ZIP Code"),
    (r"\bpostal", "Postal Code"),
    (r"\bdiagnos", "Diagnosis"),
    (r"\bicd", "ICD Code"),
    (r"\bmedical.*record", "Medical Record Number"),
    (r"\bmrn\b", "Medical Record Number"),
    (r"\bpatient.*id", "Patient ID"),
    (r"\bhealth.*id", "Health ID"),
    (r"\binsurance.*id", "Insurance ID"),
    (r"\bpolicy.*num", "Policy Number"),
    (r"\bprescription", "Prescription"),
    (r"\bmedication", "Medication"),
    (r"\bdrug\b", "Drug"),
    (r"\btreatment", "Treatment"),
    (r"\bprocedure", "Procedure"),
    (r"\bsurgery", "Surgery"),
    (r"\blab.*result", "Lab Result"),
    (r"\btest.*result", "Test Result"),
    (r"\bvital", "Vital Signs"),
    (r"\ballerg", "Allergy"),
    (r"\bimmuni[zs]", "Immunization"),
    (r"\bvaccin", "Vaccination"),
    (r"\bdob\b", "Date of Birth"),
    (r"\bdate.*birth", "Date of Birth"),
    (r"\bbirth.*date", "Birth Date"),
    (r"\bbirthday", "Birthday"),
    (r"\bborn\b", "Birth date"),
    (r"\bdeath", "Date of Death"),
    (r"\bdod\b", "Date of Death"),
    (r"\bcredit.*card", "Credit Card"),
    (r"\bcard.*num", "Card Number"),
    (r"\bbank.*account", "Bank Account"),
    (r"\biban\b", "IBAN"),
    (r"\brouting.*num", "Routing Number"),
    (r"\baccount.*num", "Account Number"),
    (r"\bsalary", "Salary"),
    (r"\bincome", "Income"),
    (r"\bwage", "Wage"),
    (r"\bbiometric", "Biometric Data"),
    (r"\bfingerprint", "Fingerprint"),
    (r"\bretina", "Retina Scan"),
    (r"\bgenetic", "Genetic Data"),
    (r"\bdna\b", "DNA"),
    (r"\bgenome", "Genome"),
    (r"\brace\b", "Race"),
    (r"\bethnicit", "Ethnicity"),
    (r"\breligion", "Religion"),
    (r"\bsex\b", "Sex"),
    (r"\bgender", "Gender"),
    (r"\bsexual.*orient", "Sexual Orientation"),
    (r"\bpolitical", "Political Affiliation"),
    (r"\bunion.*member", "Union Membership"),
]

MEDIUM_RULES = [
    (r"\bage\b", "Age"),
    (r"\byear.*birth", "Year of Birth"),
    (r"\bmarital", "Marital Status"),
    (r"\beducation", "Education Level"),
    (r"\boccupation", "Occupation"),
    (r"\bemployment", "Employment Status"),
    (r"\bjob\b", "Job"),
    (r"\bstate\b", "State"),
    (r"\bcounty", "County"),
    (r"\bregion", "Region"),
    (r"\barea\b", "Area"),
    (r"\blocation", "Location"),
    (r"\bfacility", "Facility"),
    (r"\bclinic", "Clinic"),
    (r"\bhospital", "Hospital"),
    (r"\bdepartment", "Department"),
    (r"\bunit\b", "Unit"),
    (r"\bward\b", "Ward"),
    (r"\bvisit.*type", "Visit Type"),
    (r"\badmission", "Admission"),
    (r"\bdischarge", "Discharge"),
    (r"\blength.*stay", "Length of Stay"),
    (r"\blos\b", "Length of Stay"),
    (r"\bprovider", "Provider"),
    (r"\bphysician", "Physician"),
    (r"\bdoctor", "Doctor"),
    (r"\bnurse", "Nurse"),
    (r"\bspecialt", "Specialty"),
    (r"\breferral", "Referral"),
    (r"\bdate\b", "Date"),
    (r"\btime\b", "Time"),
    (r"\btimestamp", "Timestamp"),
    (r"\bvisit.*date", "Visit Date"),
    (r"\bservice.*date", "Service Date"),
    (r"\bcreated", "Created Date"),
    (r"\bmodified", "Modified Date"),
    (r"\bupdated", "Updated Date"),
    (r"\bcost\b", "Cost"),
    (r"\bcharge", "Charge"),
    (r"\bpayment", "Payment"),
    (r"\bbilling", "Billing"),
    (r"\binsurance", "Insurance"),
    (r"\bcoverage", "Coverage"),
    (r"\bscore\b", "Score"),
    (r"\brating", "Rating"),
    (r"\brisk\b", "Risk"),
    (r"\bseverity", "Severity"),
    (r"\bstage\b", "Stage"),
    (r"\bgrade\b", "Grade"),
    (r"\blevel\b", "Level"),
]

LOW_RULES = [
    (r"\brecord.*id", "Record ID"),
    (r"\btransaction.*id", "Transaction ID"),
    (r"\bcase.*id", "Case ID"),
    (r"\bevent.*id", "Event ID"),
    (r"\bsession.*id", "Session ID"),
    (r"\b(row|seq|sequence).*id", "Sequence ID"),
    (r"\bid\b$", "ID field"),
    (r"^id\b", "ID field"),
    (r"_id$", "ID suffix"),
    (r"\bcode\b", "Code"),
    (r"\btype\b", "Type"),
    (r"\bcategory", "Category"),
    (r"\bclass\b", "Class"),
    (r"\bstatus", "Status"),
    (r"\bflag\b", "Flag"),
    (r"\bindicator", "Indicator"),
    (r"\bcount\b", "Count"),
    (r"\btotal\b", "Total"),
    (r"\bsum\b", "Sum"),
    (r"\bavg\b", "Average"),
    (r"\baverage", "Average"),
    (r"\bnum\b", "Number"),
    (r"\bnumber\b", "Number"),
    (r"\bquantity", "Quantity"),
    (r"\bfrequency", "Frequency"),
    (r"\bdescription", "Description"),
    (r"\bnotes?\b", "Notes"),
    (r"\bcomment", "Comment"),
    (r"\bremark", "Remark"),
    (r"\bversion", "Version"),
    (r"\bsource\b", "Source"),
    (r"\borigin", "Origin"),
    (r"\bformat\b", "Format"),
]
