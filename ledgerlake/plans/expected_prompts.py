"""The full prompts around hint and text, written out for the reference SQL.

Kept apart from the prompt builder on purpose: a change there must show here.
"""

JSON_HEAD = r'''{"instruction":"You get the recognised text of one commercial invoice. Return a single JSON object with exactly the keys of `schema`, and no text around it. Types: every money, rate and quantity key holds a JSON number without currency signs or thousands marks; the date keys hold ISO 8601 calendar dates; `currency` holds an ISO 4217 code, where the schema's own value counts unless the text names another. Missing facts: use null, never a guess. An address that spans several lines becomes one line with a comma at each break. `line_items` repeats the invoice's table rows in their order and holds no row that the text lacks.","schema":{"vendor_name":"","vendor_address":"","vendor_gstin":"","invoice_number":"","invoice_date":"","due_date":"","buyer_name":"","buyer_address":"","buyer_gstin":"","currency":"'''

JSON_TAIL = r'''","subtotal":null,"tax_percent":null,"tax_amount":null,"total":null,"line_items":[{"description":"","quantity":null,"unit_price":null,"amount":null}],"notes":""},"examples":[{"input":"HARBOUR PAPER MILLS\n12 Quay Road\nPort Ellery\nGST no. 07HPMIL4410K1Z9\n\nTAX INVOICE HPM/0931          issued 3 March 2023, payable by 2 April 2023\nCustomer: Lantern Bookshop, 4 Mill Lane, Oakham (GST no. 09LANTB7723Q1Z4)\n\nArticle               Qty      Rate     Value\nA4 ream, 80 g          30      4.20    126.00\nKraft roll              2     37.00     74.00\n                     Taxable value    200.00\n                     GST at 12 %       24.00\n                     Amount due   GBP 224.00\nReturns within 14 days.","output":{"buyer_address":"4 Mill Lane, Oakham","buyer_gstin":"09LANTB7723Q1Z4","buyer_name":"Lantern Bookshop","currency":"GBP","due_date":"2023-04-02","invoice_date":"2023-03-03","invoice_number":"HPM/0931","line_items":[{"amount":126,"description":"A4 ream, 80 g","quantity":30,"unit_price":4.2},{"amount":74,"description":"Kraft roll","quantity":2,"unit_price":37}],"notes":"Returns within 14 days.","subtotal":200,"tax_amount":24,"tax_percent":12,"total":224,"vendor_address":"12 Quay Road, Port Ellery","vendor_gstin":"07HPMIL4410K1Z9","vendor_name":"Harbour Paper Mills"}}],"text":'''

PLAIN_HEAD = r'''# Task
You get the recognised text of one commercial invoice. Return a single JSON object with exactly the keys of `schema`, and no text around it. Types: every money, rate and quantity key holds a JSON number without currency signs or thousands marks; the date keys hold ISO 8601 calendar dates; `currency` holds an ISO 4217 code, where the schema's own value counts unless the text names another. Missing facts: use null, never a guess. An address that spans several lines becomes one line with a comma at each break. `line_items` repeats the invoice's table rows in their order and holds no row that the text lacks.

# Schema
{
  "vendor_name": "",
  "vendor_address": "",
  "vendor_gstin": "",
  "invoice_number": "",
  "invoice_date": "",
  "due_date": "",
  "buyer_name": "",
  "buyer_address": "",
  "buyer_gstin": "",
  "currency": "'''

PLAIN_TAIL = r'''",
  "subtotal": null,
  "tax_percent": null,
  "tax_amount": null,
  "total": null,
  "line_items": [
    {
      "description": "",
      "quantity": null,
      "unit_price": null,
      "amount": null
    }
  ],
  "notes": ""
}

# Worked example: text
HARBOUR PAPER MILLS
12 Quay Road
Port Ellery
GST no. 07HPMIL4410K1Z9

TAX INVOICE HPM/0931          issued 3 March 2023, payable by 2 April 2023
Customer: Lantern Bookshop, 4 Mill Lane, Oakham (GST no. 09LANTB7723Q1Z4)

Article               Qty      Rate     Value
A4 ream, 80 g          30      4.20    126.00
Kraft roll              2     37.00     74.00
                     Taxable value    200.00
                     GST at 12 %       24.00
                     Amount due   GBP 224.00
Returns within 14 days.

# Worked example: answer
{
  "vendor_name": "Harbour Paper Mills",
  "vendor_address": "12 Quay Road, Port Ellery",
  "vendor_gstin": "07HPMIL4410K1Z9",
  "invoice_number": "HPM/0931",
  "invoice_date": "2023-03-03",
  "due_date": "2023-04-02",
  "buyer_name": "Lantern Bookshop",
  "buyer_address": "4 Mill Lane, Oakham",
  "buyer_gstin": "09LANTB7723Q1Z4",
  "currency": "GBP",
  "subtotal": 200.0,
  "tax_percent": 12.0,
  "tax_amount": 24.0,
  "total": 224.0,
  "line_items": [
    {
      "description": "A4 ream, 80 g",
      "quantity": 30,
      "unit_price": 4.2,
      "amount": 126.0
    },
    {
      "description": "Kraft roll",
      "quantity": 2,
      "unit_price": 37.0,
      "amount": 74.0
    }
  ],
  "notes": "Returns within 14 days."
}

# Invoice to read
'''
