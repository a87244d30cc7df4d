"""How programs run: as DataFrame plans, or record by record where they must."""
