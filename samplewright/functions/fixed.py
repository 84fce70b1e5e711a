"""Names, constants and formats that results depend on."""

# File suffixes that count as images (case-sensitive).
IMAGE_EXTENSIONS = ("JPEG", "jpg", "png")

# Default shuffle seed, image size and staging chunk.
DEFAULT_SEED = 42
DEFAULT_IMAGE_SIZE = (64, 64)
DEFAULT_CHUNK = 32

# Per-channel mean and standard deviation (R, G, B).
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# Stages a run reports, in reporting order.
STAGES = ("total_sample", "staging_put", "staging_put_chunk", "collate", "batch_put")

# Raw device name -> short name, in matching order.
DEVICE_NAMES = (
    ("NVIDIA RTX A6000", "RTXA6000"),
    ("NVIDIA GeForce RTX 3090", "RTX3090"),
    ("NVIDIA RTX PRO 6000 Blackwell Server Edition", "RTXB6000"),
    ("NVIDIA L40S", "L40S"),
    ("NVIDIA A40", "A40"),
    ("NVIDIA A100 80GB PCIe", "A100-80GB"),
    ("NVIDIA A100-PCIE-40GB", "A100-40GB"),
    ("NVIDIA A100-SXM4-40GB", "A100-40GB"),
    ("NVIDIA A100-PCI", "A100-PCI"),
    ("NVIDIA H100", "H100"),
    ("NVIDIA H100 NVL", "H100"),
    ("NVIDIA H100 PCIe", "H100-PCI"),
    ("NVIDIA H200", "H200"),
    ("NVIDIA H200 NVL", "H200"),
    ("NVIDIA H200 PCIe", "H200-PCI"),
    ("NVIDIA B200", "B200"),
)

# Device names the coverage check knows.
COVERAGE_NAMES = (
    ("NVIDIA RTX A6000", "RTXA6000"),
    ("NVIDIA GeForce RTX 3090", "RTX3090"),
    ("NVIDIA RTX PRO 6000 Blackwell Server Edition", "RTXB6000"),
    ("NVIDIA L40S", "L40S"),
    ("NVIDIA A40", "A40"),
    ("NVIDIA A100-PCIE-40GB", "A100-40GB"),
    ("NVIDIA A100-SXM4-40GB", "A100-40GB"),
    ("NVIDIA H100 NVL", "H100"),
    ("NVIDIA H200 NVL", "H200"),
    ("NVIDIA B200", "B200"),
)

# Batch sizes expected per device.
EXPECTED_BATCH_SIZES = {
    "A100-40GB": (32, 64, 128, 256, 384, 512, 768, 1024, 1280),
    "A100-80GB": (32, 64, 128, 256, 384, 512, 768, 1024, 1280, 1536),
    "A100-PCI": (32, 64, 128, 256, 384, 512, 768, 1024, 1280),
    "B200": (32, 64, 128, 256, 512, 768, 1024, 1536, 2048, 2560, 3072),
    "H100": (32, 64, 128, 256, 384, 512, 768, 1024, 1280, 1536),
    "H100-PCI": (32, 64, 128, 256, 384, 512, 768, 1024, 1280, 1536),
    "H200": (32, 64, 128, 256, 512, 768, 1024, 1536, 2048, 2560),
    "H200-PCI": (32, 64, 128, 256, 512, 768, 1024, 1536, 2048, 2560),
    "L40S": (32, 64, 128, 192, 256, 384, 512, 640, 768),
    "RTX3090": (32, 64, 128, 192, 256, 320),
    "RTXA6000": (32, 64, 128, 192, 256, 384, 512, 640, 768),
    "RTXB6000": (32, 64, 128, 192, 256, 320),
}

# Models and optimizers of the expected grid.
EXPECTED_MODELS = (
    "resnet18", "resnet34", "resnet50", "resnet101", "resnet152",
    "vit_b_16", "vit_b_32", "vit_l_16", "vit_l_32", "vit_h_14",
    "swin_t", "swin_s", "swin_b",
    "swin_v2_t", "swin_v2_s", "swin_v2_b",
)
EXPECTED_OPTIMIZERS = ("adam", "sgd")

# Delay used when neither the model nor the device is known.
FALLBACK_MEAN_MS = 500.0
FALLBACK_STD_MS = 0.0

# Images per epoch and epochs of the time projection.
PROJECTION_IMAGES = 1_281_167
PROJECTION_EPOCHS = 90
