"""Domain defaults: the feature taxonomy and the synonym groups. Both are parameters everywhere."""

# Fixed values: (id, label, phrases regardless of case, acronyms as written).
FEATURES: list[tuple[str, str, list[str], list[str]]] = [
    ("sdn", "Software-Defined Networking (SDN)", ["software-defined network", "software defined network", "software-defined networking", "software defined networking"], ["SDN"]),
    ("nfv", "Network Function Virtualization (NFV)", ["network function virtualization", "network functions virtualization", "network function virtualisation"], ["NFV", "VNF", "VNFM", "NFVO", "MANO"]),
    ("sfc", "Service Function Chaining (SFC)", ["service function chaining", "service chain", "network slice selection", "slice orchestration"], ["SFC"]),
    ("network_slicing", "Network Slicing", ["network slicing", "network slice"], []),
    ("oran", "Open RAN (O-RAN)", ["o-ran", "open ran", "open radio access network", "cloud ran", "virtualized ran"], ["RAN", "VRAN", "CRAN"]),
    ("orchestration", "Network Orchestration & Automation", ["orchestration", "orchestrator", "intent-based", "intent based", "intent driven", "zero-touch", "zero touch network", "closed-loop automation", "self-healing", "self-optimizing", "autonomic network", "declarative configuration", "policy engine", "automated configuration"], []),
    ("openflow", "OpenFlow / Programmable Data Plane", ["openflow", "flow table", "flow rule", "programmable switch", "control plane", "data plane", "forwarding plane", "northbound api", "southbound api"], ["P4", "SDWAN", "SD-WAN"]),
    ("cloud_native", "Cloud-Native / Containerized Infrastructure", ["kubernetes", "container", "containerization", "microservice", "cloud native", "cloud-native", "service mesh", "virtual machine", "hypervisor"], ["DPDK"]),
    ("mec", "Multi-Access Edge Computing (MEC)", ["multi-access edge computing", "mobile edge computing", "edge computing", "fog computing"], ["MEC"]),
    ("cellular_gen", "5G/6G Cellular", ["beyond 5g", "5g", "6g"], []),
    ("5g_core", "5G Core Network Functions", ["network exposure function"], ["AMF", "SMF", "UPF", "NWDAF", "AUSF", "UDM", "PCF", "NSSF", "NRF", "GNB", "ENB"]),
    ("beamforming", "Beamforming / Massive MIMO", ["beamforming", "massive mimo", "mmwave", "millimeter wave", "spectrum sharing", "carrier aggregation"], []),
    ("mobility", "Handover & Mobility Management", ["handover", "mobility management"], ["URLLC", "EMBB", "MMTC"]),
    ("ai_orchestration", "AI/ML-Driven Network Management", ["ai orchestration", "agentic ai", "machine learning", "deep learning", "reinforcement learning", "federated learning", "large language model", "digital twin", "predictive maintenance", "anomaly detection", "traffic prediction", "network digital twin"], ["LLM"]),
    ("qos", "QoS & Traffic Engineering", ["quality of service", "latency", "throughput", "packet loss", "jitter", "reliability management", "fault tolerance", "load balancing", "traffic engineering", "network monitoring", "network telemetry", "resource allocation", "resource scheduling"], ["QOS", "SLA"]),
    ("security", "Network Security & Access Control", ["network security", "authentication", "zero trust", "zero-trust", "encryption", "access control", "multi-tenant", "isolation"], []),
    ("vnf_lifecycle", "VNF Placement & Lifecycle Management", ["network function placement", "vnf placement", "vnf migration", "provisioning", "self-service"], []),
]

# Label, then variants.
SYNONYMS: list[list[str]] = [
    ["SDN", "sdn", "software defined network", "software defined networking", "軟體定義網路", "軟體定義網絡", "软件定义网络"],
    ["NFV", "nfv", "network function virtualization", "network functions virtualization", "network function virtualisation", "network functions virtualisation", "網路功能虛擬化", "網絡功能虛擬化", "网络功能虚拟化"],
    ["VNF", "vnf", "virtual network function", "virtualized network function", "virtualised network function", "虛擬網路功能", "虚拟网络功能"],
    ["network slicing", "network slicing", "network slice", "網路切片", "網絡切片", "网络切片"],
    ["5G", "5g", "fifth generation", "第五代行動通訊", "第五代移動通信"],
    ["6G", "6g", "sixth generation"],
    ["MEC", "mec", "multi access edge computing", "mobile edge computing", "多接取邊緣運算", "移動邊緣計算"],
    ["edge computing", "edge computing", "邊緣運算", "边缘计算"],
    ["RAN", "ran", "radio access network", "無線接取網路", "无线接入网"],
    ["QoS", "qos", "quality of service", "服務品質", "服务质量"],
    ["QoE", "qoe", "quality of experience", "體驗品質"],
    ["orchestration", "orchestration", "orchestrator", "協作編排", "编排"],
    ["MANO", "mano", "management and orchestration"],
    ["intent-based", "intent based", "intent driven", "意圖導向", "基于意图"],
    ["zero-touch", "zero touch", "零接觸"],
    ["AI", "ai", "artificial intelligence", "人工智慧", "人工智能"],
    ["machine learning", "machine learning", "機器學習", "机器学习"],
    ["deep learning", "deep learning", "深度學習", "深度学习"],
    ["reinforcement learning", "reinforcement learning", "強化學習", "强化学习"],
    ["digital twin", "digital twin", "數位孿生", "數字孿生", "数字孪生"],
    ["load balancing", "load balancing", "load balancer", "負載平衡", "负载均衡"],
    ["controller", "controller", "控制器"],
    ["OpenFlow", "openflow"],
    ["virtual machine", "virtual machine", "虛擬機", "虚拟机"],
    ["container", "container", "容器"],
    ["cloud", "cloud", "雲端", "云"],
    ["security", "security", "資安", "安全"],
    ["latency", "latency", "時延", "延遲", "时延"],
    ["routing", "routing", "路由"],
    ["traffic engineering", "traffic engineering", "流量工程"],
]

# Words of a query that are no concepts.
QUERY_STOP = ["and", "or", "the", "of", "for", "in", "on", "with", "a", "an", "to", "的", "與", "和", "及"]
