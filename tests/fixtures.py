"""Deterministic synthetic stand-ins for the four original datasets (rule-generated)."""

import csv
import math
import os


def _write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh, lineterminator="\r\n")
        w.writerow(header)
        w.writerows(rows)
    return path


def loan_csv(tmp_dir, n=614, n_yes=422):
    header = ["Loan_ID", "Gender", "Married", "Dependents", "Education", "Self_Employed",
              "ApplicantIncome", "CoapplicantIncome", "LoanAmount", "Loan_Amount_Term",
              "Credit_History", "Property_Area", "Loan_Approved"]
    terms = [360, 360, 360, 180, 480, 300, 360, 240, 84, 120]
    rows = []
    for i in range(n):
        yes = ((i * 7919) % n) < n_yes
        credit = 1.0 if (yes or i % 9 == 0) and i % 23 != 0 else 0.0
        rows.append([
            f"LP{i:06d}",
            "" if i % 37 == 0 else ("Male" if i % 5 else "Female"),
            "" if i % 53 == 0 else ("Yes" if i % 3 else "No"),
            "" if i % 41 == 0 else ["0", "1", "2", "3+"][i % 4 if i % 4 else 0],
            "Graduate" if i % 4 else "Not Graduate",
            "NA" if i % 29 == 0 else ("Yes" if i % 7 == 0 else "No"),
            str(1500 + (i * 137) % 9000), str(float((i * 61) % 3000)),
            "" if i % 31 == 0 else str(float(60 + (i * 13) % 400)),
            "" if i % 43 == 0 else str(float(terms[i % 10])),
            "" if i % 17 == 0 else str(credit),
            ["Urban", "Rural", "Semiurban"][i % 3],
            "Y" if yes else "N",
        ])
    return _write(os.path.join(tmp_dir, "loan.csv"), header, rows)


def admission_csv(tmp_dir, n=500):
    header = ["Serial_No", "GRE_Score", "TOEFL_Score", "University_Rating", "SOP", "LOR", "CGPA",
              "Research", "Admit_Chance"]
    rows = []
    for i in range(1, n + 1):
        u = ((i * 37) % 100) / 100.0            # latent ability in [0, 1)
        gre = 290 + round(50 * u + (i % 7) - 3)
        toefl = 92 + round(28 * u + (i % 5) - 2)
        rating = 1 + min(4, int(5 * ((u + (i % 3) * 0.1) % 1.0)))
        sop = 1 + ((i * 3) % 9) * 0.5
        lor = 1 + ((i * 5) % 9) * 0.5
        cgpa = round(6.8 + 3.1 * u, 2)
        research = 1 if (i % 9) < 5 else 0
        chance = round(min(0.97, max(0.34, 0.34 + 0.6 * u + 0.02 * research)), 2)
        rows.append([i, gre, toefl, rating, sop, lor, cgpa, research, chance])
    return _write(os.path.join(tmp_dir, "admission.csv"), header, rows)


def mall_csv(tmp_dir, n=200):
    header = ["Customer_ID", "Gender", "Age", "Annual_Income", "Spending_Score"]
    centres = [(25, 20), (25, 80), (55, 50), (90, 15), (90, 85)]
    rows = []
    for i in range(1, n + 1):
        cx, cy = centres[i % 5]
        dx = ((i * 7) % 11) - 5
        dy = ((i * 13) % 11) - 5
        rows.append([i, "Female" if i % 9 < 5 else "Male", 18 + (i * 7) % 52, cx + dx, cy + dy])
    return _write(os.path.join(tmp_dir, "mall.csv"), header, rows)


def price_rows(n=400):
    rows = []
    for i in range(n):
        condo = 1 if i % 3 == 0 else 0
        beds = 1 + i % 5
        baths = 1 + i % 3
        area = 500.0 + (i * 37) % 2500
        year = 1950 + (i * 11) % 70
        resid = ((i * 7919) % 2001 - 1000) * 20.0
        price = 50000 + 120.0 * area + 15000 * beds + 10000 * baths + 800 * (year - 1950) - 40000 * condo + resid
        rows.append((i, float(price), condo, 1 - condo, beds, baths, area, year))
    return rows


PRICE_SCHEMA = ("id long, price double, property_type_Condo int, property_type_House int, beds int, "
                "baths int, area double, year_built int")
