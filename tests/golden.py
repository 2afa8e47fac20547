"""Sample listings and requests with known results."""

LISTINGS = [
    ("1", "Senior Frontend Engineer", "Stripe", "Remote", "full-time", "$120k–$160k", 97, "LinkedIn", "#", "2h ago", False),
    ("2", "React Developer", "Linear", "Remote", "full-time", "$90k–$120k", 94, "RemoteOK", "#", "4h ago", False),
    ("3", "Frontend Engineer", "Vercel", "Remote", "full-time", "$100k–$140k", 91, "LinkedIn", "#", "6h ago", True),
    ("4", "UI Engineer", "Figma", "Remote / SF", "full-time", "$110k–$150k", 88, "Indeed", "#", "8h ago", False),
    ("5", "JavaScript Engineer", "Shopify", "Remote", "full-time", "$95k–$130k", 86, "Glassdoor", "#", "12h ago", False),
    ("6", "React Native Developer", "Expo", "Remote", "contract", "$80–$100/hr", 83, "RemoteOK", "#", "1d ago", False),
    ("7", "Frontend Team Lead", "Notion", "Remote / NYC", "full-time", "$130k–$170k", 80, "LinkedIn", "#", "1d ago", False),
    ("8", "Web Developer", "Wuzzuf Partner", "Cairo, Egypt", "full-time", "E£25k–E£40k", 76, "Wuzzuf", "#", "2d ago", False),
]

SAMPLE_REQUEST = """{
  "userId": "123",
  "workPreference": "remote",
  "location": {"country": "Egypt", "city": "Cairo"},
  "field": "Software Engineering",
  "skills": ["JavaScript", "React", ".NET"],
  "experience": 2,
  "jobType": "Full-time",
  "seniority": "Mid",
  "apiKey": "SECRET"
}"""

SAMPLE_RUN = {"LinkedIn": 142, "Indeed": 87, "RemoteOK": 34, "Wuzzuf": 61}
SAMPLE_RUN_TOTAL = 324
